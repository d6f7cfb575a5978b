"""Operators for training-data pipelines: texts, embeddings, urls and conversations. Nothing else imports this package."""
