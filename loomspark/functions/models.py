"""Names of token models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of token models, in lower case, by the model they mean.
ALIASES = {
    "cl100k": ("cl100k", "cl100k_base", "default"),
    "o200k": ("o200k", "o200k_base"),
    "gpt4": ("gpt4", "gpt-4", "gpt-4-turbo"),
    "gpt4o": ("gpt4o", "gpt-4o"),
    "gpt35": ("gpt35", "gpt-3.5", "gpt-3.5-turbo"),
    "claude3": ("claude", "claude3", "claude-3", "claude-3.5"),
    "heuristic": ("heuristic", "fast", "estimate"),
}


def token_model(name: Column) -> Column:
    """The model that a spelling means, whatever its case and blanks; null for null and unknown ones."""
    plain = F.lower(F.trim(name))
    out = None
    for model, spellings in ALIASES.items():
        hit = plain.isin(*spellings)
        out = F.when(hit, model) if out is None else out.when(hit, model)
    return out
