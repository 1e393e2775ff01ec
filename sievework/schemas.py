"""Record types of the corpus stages and the reserved token ids."""

from __future__ import annotations

#: Reserved ids; ids of the native vocabulary begin above them.
BOS, EOS, MASK_ID, PAD, FIRST_NATIVE = 50281, 50282, 50284, 50283, 50368

TEXT = "id string, text string"
TOKENIZED = "id string, input_ids array<int>"
PRE_TOKENIZED = "id string, input_ids array<int>, len int"
PRE_TOKENIZED_DOMAIN = PRE_TOKENIZED + ", domain string"
CHUNK = "id string, chunk_no int, input_ids array<int>, len int"
FOLDER_STATS = "folder string, total_tokens_written bigint, total_tokens_skipped bigint, total_duplicated_tokens bigint, percentiles map<string,int>"
DECODED = "id string, text string, domain string"
WINOGENDER = "sentid string, sentence string, pronoun string, occupation string, participant string, gender string, target string"
