"""strandline.operators"""
