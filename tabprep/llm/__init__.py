"""Training-data operators: decontamination, quality, language models, token
counts, personal data, sampled segmentation, language ID, set joins, URL and
secret filters. Nothing outside this subpackage imports it."""
