"""Feature-text and answer-mapping expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature name -> columns of the canonical article schema joined with ' '.
# Per-dataset overrides mirror which source columns each dataset has;
# None means the feature is not available for that dataset.
FEATURES = {
    "title_subtitle": ["title", "subtitle"],
    "title": ["title"],
    "snippet_description": ["summary"],
    "url_heading_subhead": ["url", "title", "subtitle"],
    "url_raw": ["url"],
    "url_path_raw": ["path"],
    "url_path_cleaned": ["path_clean"],
}
DATASET_FEATURE_OVERRIDES = {
    "uci": {"title_subtitle": ["title"], "snippet_description": None,
            "url_heading_subhead": ["url", "title"]},
    "huffpo": {"snippet_description": ["subtitle"]},
    "articles": {"snippet_description": None},
}


def register_feature(name: str, columns: list[str], per_dataset: dict | None = None) -> None:
    """Extension point: add a feature as a column list (with optional
    per-dataset column lists or None for 'not available')."""
    FEATURES[name] = list(columns)
    for ds, cols in (per_dataset or {}).items():
        DATASET_FEATURE_OVERRIDES.setdefault(ds, {})[name] = cols


def feature_columns(feature: str, dataset: str) -> list[str] | None:
    if feature not in FEATURES:
        raise ValueError(f"unknown feature: {feature}")
    over = DATASET_FEATURE_OVERRIDES.get(dataset, {})
    return over[feature] if feature in over else FEATURES[feature]


def feature_text(feature: str, dataset: str) -> Column | None:
    """Texts joined with ' '; one missing part empties the whole text (as
    string '+' does in pandas), then missing becomes ''."""
    cols = feature_columns(feature, dataset)
    if cols is None:
        return None
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(" "))
        parts.append(F.col(c))
    return F.coalesce(F.concat(*parts), F.lit(""))


def map_answer(answer, categories: list[str]) -> Column:
    """Free-text answer -> category: case-folded exact match first, else the
    first category (in list order) contained in the answer or containing it,
    else NULL."""
    a = F.col(answer) if isinstance(answer, str) else answer
    clean = F.lower(F.regexp_replace(a, r"(?U)^\s+|\s+$", ""))
    exact = partial = None
    for c in categories:
        low = F.lit(c.lower())
        e_cond = clean == low
        p_cond = F.contains(clean, low) | F.contains(low, clean)
        exact = F.when(e_cond, F.lit(c)) if exact is None else exact.when(e_cond, F.lit(c))
        partial = F.when(p_cond, F.lit(c)) if partial is None else partial.when(p_cond, F.lit(c))
    return F.coalesce(exact, partial) if categories else F.lit(None).cast("string")


def parse_category_line(text, codes: dict[str, int]) -> Column:
    """'Category: X' on the first line -> code of X, NULL when absent/unknown."""
    t = F.col(text) if isinstance(text, str) else text
    first = F.split_part(t, F.lit("\n"), F.lit(1))
    name = F.split_part(first, F.lit("Category: "), F.lit(2))
    m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return F.when(first.contains("Category: "), F.try_element_at(m, name))


def prompt_text(template: str, categories: list[str], text, max_len: int = 2500) -> Column:
    """Template with {categories} (comma-joined) and {text} (truncated)."""
    t = F.col(text) if isinstance(text, str) else text
    filled = F.replace(F.lit(template), F.lit("{categories}"), F.lit(", ".join(categories)))
    return F.replace(filled, F.lit("{text}"), F.substring(t, 1, max_len))


def relabel(col, mapping: dict[str, str], keep_unknown: bool = True) -> Column:
    """Display names through a lookup; unknown values kept (or NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    hit = F.try_element_at(m, c)
    return F.coalesce(hit, c) if keep_unknown else hit


def replace_text(col, old: str, new: str) -> Column:
    """Substring relabel (e.g. a renamed feature)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(c, F.lit(old), F.lit(new))


def variant_name(col, default: str = "cleaned_path") -> Column:
    """The name of a URL variant; a missing one is the default variant."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(default))
