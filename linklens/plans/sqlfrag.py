"""DuckDB SQL fragments mirroring the column functions (oracle side only)."""

from linklens.functions import urls as U

PAT = U.URL_PATTERN


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '{PAT}', 2)"


def path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, '{PAT}', 3), ';[^/]*$', '')"


def clean(p: str) -> str:
    return f"regexp_replace({p}, '[/\\-\\\\]', ' ', 'g')"


def segs(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda s: s <> '')"


def first_section(u: str) -> str:
    return f"split_part(split_part({u}, '://', 2), '/', 2)"


def candidate_slugs(p: str) -> str:
    return (f"list_filter(list_transform(string_split({p}, '/'), lambda s: trim(s)), "
            f"lambda s: length(s) > 2 AND NOT regexp_full_match(s, '[0-9]+'))")


def skeleton(p: str) -> str:
    return ("'/' || array_to_string(list_transform(" + segs(p) + ", lambda s: CASE "
            "WHEN regexp_full_match(s, '[0-9]+') THEN '{num}' "
            "WHEN regexp_full_match(s, '[0-9a-fA-F]{8,}') THEN '{id}' ELSE s END), '/')")


def strip_dates(p: str) -> str:
    e = p
    for pat in U.DATE_PATTERNS:
        e = f"regexp_replace({e}, '{pat}', '', 'g')"
    e = f"regexp_replace({e}, '/{{2,}}', '/', 'g')"
    e = f"regexp_replace({e}, '-{{2,}}', '-', 'g')"
    return f"regexp_replace({e}, '[/-]+$', '', 'g')"


def structure(p: str) -> dict:
    sg = segs(p)
    d = f"length(regexp_replace({p}, '[^0-9]', '', 'g'))"
    a = f"length(regexp_replace({p}, '[^a-zA-Z]', '', 'g'))"
    sem = "\\b(" + "|".join(U.SEMANTIC_WORDS) + ")\\b"
    cats = ", ".join(f"'{c}'" for c in U.CATEGORY_FIRST_SEGMENTS)
    c = {
        "has_numbers": f"regexp_matches({p}, '[0-9]')",
        "has_dates": f"regexp_matches({p}, '{U.HAS_DATES}')",
        "has_year": f"regexp_matches({p}, '{U.HAS_YEAR}')",
        "has_month": f"regexp_matches({p}, '{U.HAS_MONTH}')",
        "has_underscores": f"contains({p}, '_')",
        "has_hyphens": f"contains({p}, '-')",
        "has_file_extension": f"regexp_matches({p}, '{U.HAS_FILE_EXTENSION}')",
        "is_id_heavy": f"({d} + {a} > 0 AND {d} * 2 > {d} + {a})",
        "is_semantic": f"regexp_matches(lower({p}), '{sem}')",
        "has_category_indicators": f"(len({sg}) >= 2 AND coalesce(lower({sg}[1]) IN ({cats}), false))",
        "path_length": f"length({p})",
        "num_segments": f"len({sg})",
        "avg_segment_length": (f"CASE WHEN len({sg}) = 0 THEN 0.0 ELSE "
                               f"CAST(list_sum(list_transform({sg}, lambda s: length(s))) AS DOUBLE) / len({sg}) END"),
    }
    c["url_type"] = (
        f"CASE WHEN {c['is_id_heavy']} AND NOT {c['is_semantic']} THEN 'id_based' "
        f"WHEN {c['is_semantic']} AND {c['has_category_indicators']} THEN 'semantic_structured' "
        f"WHEN {c['is_semantic']} THEN 'semantic_unstructured' "
        f"WHEN {c['has_dates']} OR {c['has_year']} THEN 'date_based' "
        f"WHEN len({sg}) <= 2 AND length({p}) < 50 THEN 'simple' ELSE 'mixed' END")
    return c


def rule_label(p: str) -> str:
    parts = []
    for name, pat in U.DEFAULT_RULES.items():
        if pat.startswith("(?i)"):
            parts.append(f"WHEN regexp_matches({p}, '{pat[4:]}', 'i') THEN '{name}'")
        else:
            parts.append(f"WHEN regexp_matches({p}, '{pat}') THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'other' END"
