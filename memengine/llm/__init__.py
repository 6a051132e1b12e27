"""Training-data operators: dedup, classifiers, decontamination, tokens, chat, vectors."""
