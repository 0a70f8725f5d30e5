"""Every query of this package; importing this module registers them."""

from topicloom.llm import (  # noqa: F401
    decontaminate,
    html_text,
    jaccard_join,
    language_id,
    licenses,
    mixing,
    periodic_runs,
    pieces,
    quality,
    spelling,
    token_files,
    topk_search,
    warc,
)
from topicloom.llm.registry import ORACLES, QUERIES  # noqa: F401
