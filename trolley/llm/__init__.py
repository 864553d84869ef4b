"""Operations for building training corpora: quality rules, near-duplicates, decontamination,
tokenising, language, archives, URL filters, secrets and page text. Nothing outside imports it."""
