from .text import is_blank, seed_order, tokens  # noqa: F401
from .payloads import (  # noqa: F401
    clean_confidence, label_array, min_confidence, normalise_payload, normalise_payloads,
    parse_predictions,
)
from .replies import build_prompt, extract_label, label_keys, reply_cost, reply_record  # noqa: F401
