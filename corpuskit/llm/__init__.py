"""Training-data operators (packing, language ID, quality, token files, URL
filters, decontamination, exact-substring and near-duplicate removal, PII,
line dedup).  Nothing outside this subpackage imports it."""
