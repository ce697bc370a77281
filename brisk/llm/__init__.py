"""Training-data operators: filtering, de-duplication, tokenisation and layout of text corpora."""
