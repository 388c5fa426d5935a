"""tidemark functions"""
