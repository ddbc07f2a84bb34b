"""The column functions as SQL functions of a session.

A function's expression over named parameters becomes the body of a temporary SQL function, so
SQL text is optimized as the DataFrame form is. Functions that need Python are registered as such.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodemill.functions import code, scalars, text
from lodemill.functions.comments import strip_comments

#: Function and the types of its parameters, all strings unless said otherwise.
FUNCTIONS: dict[str, tuple[Callable[..., Column], str]] = {
    "norm_cwe": (scalars.norm_cwe, "value string"),
    "cwe_in_text": (scalars.cwe_in_text, "value string"),
    "norm_model_cwe": (scalars.norm_model_cwe, "value string"),
    "norm_lang": (scalars.norm_lang, "value string"),
    "lang_from_path": (scalars.lang_from_path, "path string"),
    "llm_key": (scalars.llm_key, "value string"),
    "owasp_2025": (scalars.owasp_2025, "value string"),
    "norm_owasp": (scalars.norm_owasp, "value string"),
    "cvss_of": (scalars.cvss, "value string, cwe string"),
    "stable_id": (scalars.stable_id, "prefix string, code string"),
    "provenance": (scalars.provenance, "source string, sample string"),
    "parse_purl": (scalars.parse_purl, "purl string"),
    "verdict": (scalars.verdict, "text string"),
    "json_object_of": (scalars.json_object, "text string"),
    "as_flag": (scalars.as_flag, "value string"),
    "to_float": (scalars.to_float, "value string"),
    "token_f1": (scalars.token_f1, "a string, b string"),
    "normal_code": (scalars.normal_code, "code string"),
    "code_key": (scalars.code_key, "language string, code string"),
    "location_hit": (scalars.location_hit, "code string, said string"),
    "path_parts": (scalars.path_parts, "path string"),
    "advisory_status": (scalars.advisory_status, "fix_sha string, has_parent boolean, n_sources int, n_patched int"),
    "review_label": (scalars.review_label, "code string, label string, cwe string"),
    "clean_value": (scalars.clean, "value string"),
    "blank_to_null": (scalars.blank_to_null, "value string"),
    "full_name": (scalars.full_name, "url string"),
    "last_segments": (scalars.last_segments, "url string"),
    "severity": (scalars.severity, "score double"),
    "age_in_days": (scalars.age_in_days, "created timestamp, now timestamp"),
    "clean_markup": (text.clean_markup, "text string"),
    "readme_snippet": (text.readme_snippet, "text string"),
    "is_english": (text.is_english, "text string"),
    "is_excluded_path": (text.is_excluded_path, "path string"),
    "doc_type": (text.doc_type, "path string"),
    "version_key": (text.version_key, "repository string, path string"),
    "normal_hash": (text.normal_hash, "text string"),
}
PYTHON = {"seq_ratio": scalars.seq_ratio, "strip_comments": strip_comments, "strip_names": text.strip_names}

#: A literal, or an operator that the expression's text has as a function.
_PREFIX = re.compile(r"'(?:\\.|[^'\\])*'|(<=>|>=|<=|!=|[-+*/%=<>!&|^~]|\b(?:and|or|in|not)\b)(?=\()")


def body_of(function: Callable[..., Column], names: list[str]) -> str:
    """A function's expression over columns of these names as SQL text."""
    plain = function(*[F.col(n) for n in names])._jc.node().sql()
    return _PREFIX.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], plain)


def register(spark: SparkSession) -> list[str]:
    """Make the functions callable from SQL in this session; their names."""
    for name, (function, parameters) in FUNCTIONS.items():
        names = [p.split()[0] for p in parameters.split(",")]
        kind = spark.createDataFrame([], parameters).select(function(*[F.col(n) for n in names]).alias("r")).schema["r"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body_of(function, names)}")
    for name, function in PYTHON.items():
        spark.udf.register(name, function)
    for name, table in code.UDTFS.items():
        spark.udtf.register(name, table)
    return [*FUNCTIONS, *PYTHON, *code.UDTFS]
