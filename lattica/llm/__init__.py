"""Operations of a training-data pipeline over the tables of documents, embeddings and conversations.

Nothing outside this subpackage imports it.
"""
