"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from loam.llm import oracles
from loam.llm.decontaminate import op12_decontamination
from loam.llm.jaccard import op10_jaccard
from loam.llm.language import op7_language
from loam.llm.lm import op6_lm
from loam.llm.media import op3_media
from loam.llm.merkle import op11_merkle
from loam.llm.mixing import op1_mixing
from loam.llm.neighbours import op2_neighbours
from loam.llm.packing import op4_packing
from loam.llm.quality import op8_quality
from loam.llm.resampling import op13_resampling
from loam.llm.sharding import op9_sharding
from loam.llm.warc import op5_warc


def queries() -> dict[str, Callable]:
    return {
        "op1_mixing": op1_mixing,
        "op2_neighbours": op2_neighbours,
        "op3_media": op3_media,
        "op4_packing": op4_packing,
        "op5_warc": op5_warc,
        "op6_lm": op6_lm,
        "op7_language": op7_language,
        "op8_quality": op8_quality,
        "op9_sharding": op9_sharding,
        "op10_jaccard": op10_jaccard,
        "op11_merkle": op11_merkle,
        "op12_decontamination": op12_decontamination,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle": oracles.OP11, "op12_decontamination": oracles.OP12, "op13_resampling": oracles.OP13}
