"""Where the two SQL dialects differ: marks in a text that become Spark's or DuckDB's form, and seeded draws made of them."""

from __future__ import annotations

#: mark -> (Spark, DuckDB)
_MARKS = {
    "<hex>": ("cast(conv(", "('0x' || "), "</hex>": (", 16, 10) AS bigint)", ")::BIGINT"),
    "<sha>": ("sha2(", "sha256("), "</sha>": (", 256)", ")"),
    # every whole number from the first to the second, as rows
    "<each>": ("explode(sequence(", "unnest(generate_series("), "</each>": ("))", "))"),
}


def _with(text: str, which: int) -> str:
    for mark, forms in _MARKS.items():
        text = text.replace(mark, forms[which])
    return text


def spark_text(text: str) -> str:
    return _with(text, 0)


def duck_text(text: str) -> str:
    return _with(text, 1)


def draw(stream: int, *keys: str) -> str:
    """A number in [0, 1) that depends on the stream and the keys alone: 52 bits of their digest, so draws of other keys are independent."""
    return f"(<hex>substr(md5(concat_ws(':', {stream}, {', '.join(keys)})), 1, 13)</hex> / 4503599627370496e0)"
