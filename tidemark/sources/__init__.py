"""tidemark sources"""
