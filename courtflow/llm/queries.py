"""All registered queries of this subpackage."""

from courtflow.llm import bpe, chat, fingerprint, jaccard_join, mixing, pii, prefix_trie, quality, token_align, topk, toxicity, url_filter, warc  # noqa: F401
from courtflow.llm.common import CHECKS, QUERIES  # noqa: F401
