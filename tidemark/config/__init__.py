"""tidemark config"""
