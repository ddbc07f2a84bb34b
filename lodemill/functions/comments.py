"""Comments out of code; string literals stay whole."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Literals, which may go over line ends, and comments.
_LITERAL = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'", re.S)
_BLOCK, _HASH, _SLASH = re.compile(r"/\*[\s\S]*?\*/|<!--[\s\S]*?-->"), re.compile(r"#[^\n]*"), re.compile(r"//[^\n]*")
_HELD = re.compile("\0(\\d+)\0")
_LEAK, _CODE = re.compile(r"\b(VULNERABLE|SECURE)\b", re.I), re.compile(r"\b(def|function|class|return|const|let|var)\b")


def without_comments(code: str | None, language: str | None) -> str:
    """Comments and lines that give a label away removed; line ends trimmed, at most one blank line in a row.

    Literals are taken out first, wherever they begin, and put back last. So a quote in a comment
    begins a literal, which protects what follows up to the next such quote.
    """
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m.group())
        return f"\0{len(held) - 1}\0"

    kept = _LITERAL.sub(hold, code or "")
    for comment in (_BLOCK, *([] if language == "python" else [_SLASH]), _HASH):
        kept = comment.sub("", kept)
    kept = _HELD.sub(lambda m: held[int(m[1])], kept)
    lines = [x.rstrip() for x in kept.splitlines() if not _LEAK.search(x) or _CODE.search(x)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(T.StringType())
def strip_comments(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([without_comments(c, x) for c, x in zip(code, language, strict=True)], dtype=object)
