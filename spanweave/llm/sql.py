"""Pieces of oracle SQL (DuckDB) that several queries share."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(table: str, key: str, extra: str = "") -> str:
    """SELECT of key and w: the lower-cased words of each text."""
    return f"SELECT {key}{extra}, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}"


def shingles(source: str, key: str) -> str:
    """SELECT of key and sh: distinct 5-word shingles of a words relation."""
    return (
        f"SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) "
        f"WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM {source}"
    )
