"""tidemark operators"""
