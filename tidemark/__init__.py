"""tidemark """
