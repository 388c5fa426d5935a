"""tidemark plans"""
