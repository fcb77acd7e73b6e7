"""Corpus preparation for language-model training: ten operators and the pipeline over them."""
