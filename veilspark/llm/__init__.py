"""Training-data operators: mixing, scoring, decontamination, personal data, language, near-duplicates, chat, shards, records,
clusters, prefix tries, repeats."""
