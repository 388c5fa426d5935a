"""tidemark sinks"""
