"""Prompts as columns: a text with named places for each of the seven tasks, filled from columns of a row.

The wording is this package's own. What an answer must hold is what operators.model and operators.judge read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Task to text; {name} is a place. Answers are JSON.
TEXTS = {
    "classify": "Choose the one category that fits this product.\nCategories:\n{options}\nProduct:\n{text}\nAnswer with category (a key of the list), confidence from 0 to 1, and the words that decided it as reason.",
    "extract": "Read attributes out of a source; leave out what it doesn't say.\nSource {source}:\n{text}\nAttributes:\n{attributes}\nKnown already:\n{known}\nAnswer with items: key, value as written, unit, evidence (the very words), uncertain. Specifications without a key go to unmapped.",
    "vision": "Read what is legible on this picture of {product}.\nAttributes:\n{attributes}\nAnswer with visible_text (lines, in order), items as in extraction with legibility, and image_quality: clear, acceptable or poor.",
    "infer": "Fill gaps of a {category} from what is verified; skip what would be a guess.\nVerified:\n{verified}\nSimilar products:\n{similar}\nMissing:\n{missing}\nAnswer with items: key, value, basis (same_series, similar_products or domain_knowledge), evidence.",
    "content": "Write catalogue texts for {brand} {sku}, a {category}, with nothing but these facts.\nFacts:\n{verified}\nTexts and their lengths in characters:\n{targets}\nAnswer with one entry for each text, empty where the facts don't suffice.",
    "judge": "Audit the attributes of a {category}; report real errors only.\n{evidence}\nAnswer with issues (field_key, code out of {codes}, severity, message, suggestion), verdict, and confidence_adjustments by key.",
    "conflict": "Sources disagree on {label}.\nCandidates:\n{candidates}\nAnswer with winner_index from 0, same_value_different_units, reasoning, confidence.",
}


def places(task: str) -> list[str]:
    """The names of a task's places, in order."""
    return re.findall(r"\{(\w+)\}", TEXTS[task])


def prompt(task: str, **values: Column) -> Column:
    """The task's text with its places filled; a null is an empty text. A missing or unknown name is an error."""
    wanted = set(places(task))
    if wanted != set(values):
        raise ValueError(f"{task} takes {sorted(wanted)}, not {sorted(values)}")
    pieces = re.split(r"\{(\w+)\}", TEXTS[task])
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def prompt_sql(task: str, **values: str) -> str:
    """The same as a DuckDB expression."""
    pieces = re.split(r"\{(\w+)\}", TEXTS[task])
    return "concat(" + ", ".join(f"CAST({values[p]} AS VARCHAR)" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(pieces)) + ")"
