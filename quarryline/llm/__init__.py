"""Training-data operators: decontamination, packing, chat formatting, nearest
neighbours, near-duplicates, toxicity, secrets, token files, personal data and
language identification.

Nothing else in the library imports this subpackage."""
