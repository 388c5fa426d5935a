"""tidemark streaming"""
