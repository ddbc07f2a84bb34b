"""Text and scalar functions against golden values."""

import pytest
from pyspark.sql import functions as F

from lodemill.functions import scalars as S
from lodemill.functions import text as X

#: A path of our own for each rule in turn, the name rules in a folder that says nothing.
OF_NAME = ["release_notes-2.rst", "contributions.rst", "bug_report_form.yml", "code-of-conduct.fr.md", None, "copying.lesser", "requirements-lint.txt", "skill.MD", "copilot-instructions.md", "readme_first.rst", "test_results.log", "prd.md", "welcome.mdx", "first-steps.md", "self-hosted-gpu.md", "how-we-migrated.md", "old_faqs.md", "widgets-reference.md", "snippet-zebra.md", "style_guide_web.md"]
OF_FOLDER = ["newsfragments/7.txt", "issue_template/question.md", "vendor/zlib/x.md", "runs/9/out.md", "test-data/k.md", "l10n/fr/k.md", "skills/k.md", ".zoo/commands/k.md", "rules/k.md", "demos/k.md", "rfcs/12-k.md", "evals/k.md", "posts/k.md", "includes/k.md", "v2-upgrade/k.md", "troubleshooting/k.md", "onboarding/k.md", "deployments/k.md", "connectors/k.md", "fundamentals/k.md", "recipes/k.md", "glossary/k.md", "design-system/k.md"]
#: Paths on which two rules could bear, and those on which none does.
BETWEEN = {
    "SECURITY.md": "Security policy",
    "zoo/security.md": "Other (unclassified)",
    "wiki/security.md": "Docs site page (general)",
    "skills/zebra/CHANGES": "Changelog / release notes",
    "tests/README": "README",
    "rules/setup.md": "Getting started / installation",
    "rules/zebra.md": "Prompt / rule file",
    "zoo/agents.md": "Other (unclassified)",
    "zoo/AGENTS.md": "Agent instructions",
    "i18n/en_GB/k.md": "Other (unclassified)",
    "i18n/en_GB/guides/k.md": "Guide / how-to",
    "examples/blog/k.md": "Example / tutorial",
    "website/zebra/k.md": "Docs site page (general)",
    "zoo/zebra.md": "Other (unclassified)",
}


@pytest.fixture
def over(spark):
    def run(values, function, kind="string"):
        rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)]
        width = len(rows[0]) - 1
        df = spark.createDataFrame(rows, "k int, " + ", ".join(f"c{i} {kind}" for i in range(width)))
        return [r["r"] for r in df.select("k", function(*[F.col(f"c{i}") for i in range(width)]).alias("r")).orderBy("k").collect()]

    return run


def test_a_path_for_each_doc_type(over):
    from lodemill.rules.documents import DOC_TYPES

    assert len(OF_NAME) + len(OF_FOLDER) == len(DOC_TYPES)
    for path, (label, _), got in zip([p and f"zoo/{p}" for p in OF_NAME] + [f"zoo/{p}" for p in OF_FOLDER], DOC_TYPES, over([p and f"zoo/{p}" for p in OF_NAME] + [f"zoo/{p}" for p in OF_FOLDER], X.doc_type), strict=True):
        assert path is None or got == label, path


def test_paths_between_doc_types(over):
    assert dict(zip(BETWEEN, over(list(BETWEEN), X.doc_type))) == BETWEEN


def test_excluded_paths(over):
    out = ["zoo/vendor/k.md", "testdata/k.rst", "a/__snapshots__/k.md", "locale/pt_BR/k.md", "l10n/enx/k.md", "notes.txt", "zoo/READ.TXT"]
    kept = ["l10n/en/k.md", "i18n/k.md", "zoo/readme.TXT", "vendors/k.md", "llms-full.txt"]
    assert over(out + kept, X.is_excluded_path) == [True] * len(out) + [False] * len(kept)


def test_english(over):
    yes = ["The zebra and the heron are in the zoo.", "run it with this"]
    no = ["El zorro y la garza duermen.", "斑马在动物园里。", "zebra heron otter newt", "", None, "3 + 4 !", "the öäüß and ñçé of àèì"]
    assert over(yes + no, X.is_english) == [True] * len(yes) + [False] * len(no)


def test_markup(over):
    page = "---\nname: Zoo\ncolour: red\n---\nimport Cage from './cage'\n<Cage size=3>An ![otter](o.png) eats [fish](http://f.io)</Cage>\n<!-- not\nshown -->\n:---:|---\nmore at https://zoo.io/x now"
    notice = "Licensed under the Zoo License; limitations under the License.\nOtters swim."
    (a, b) = over([page, notice], X.clean_markup)
    assert " ".join(a.split()) == "Zoo An otter eats fish more at now"
    assert b.split() == ["Otters", "swim."]


def test_outline(over):
    (text, blank, none) = over(["# Otters #\nThey swim.\n~~~\n# code\n~~~\nHerons\n======\nThey fly.", "\n\t", None], X.modeling_text)
    head, _, rest = text.partition("\n")
    assert head == "Otters; Herons" and "They swim." in rest and "code" not in text and blank is None and none is None


def test_strip_names(over):
    assert over([("OtterBox is by Zookeeper.", "zookeeper/otterbox"), ("The sim runs", "zoo-org/sim"), ("ox and pi", "ox/pi"), (None, "zoo/otter"), ("kept", None)], X.strip_names) == ["  is by  .", "The sim runs", "ox and pi", None, "kept"]


def test_scalars(over):
    assert over(["see CWE 0125 here", "none", None, "7"], S.norm_cwe) == ["CWE-125", "", "", "CWE-7"]
    assert over(["llm7", "cwe-416: use", "LLM08 or so", None], S.norm_model_cwe) == ["LLM07", "CWE-416", "LLM08", ""]
    assert [tuple(x) for x in over(["it is safe", "VULNERABLE, CWE-787", None, "no idea"], S.verdict)] == [("SAFE", ""), ("VULNERABLE", "CWE-787"), ("UNKNOWN", ""), ("UNKNOWN", "")]
    got = over(["pkg:npm/%40zoo/otter@1.2?os=x#p", "pkg:maven/org.zoo/heron@3", "pkg:zoo/otter@1", "pkg:pypi/otter", None], S.parse_purl)
    assert [tuple(x) if x else None for x in got] == [("npm", "@zoo/otter", "1.2"), ("Maven", "org.zoo:heron", "3"), None, None, None]
    assert over(["", " zoo "], S.owasp_2025) == ["", "zoo"]
    assert over([("4.449", "CWE-1"), ("-1", "CWE-0"), (None, "CWE-0")], S.cvss) == [4.4, 7.5, 7.5]
    assert over(["score: -2.5!", "11", "none", "", None], S.to_float) == [2.5, 11.0, None, None, None]
    assert over([("otter heron", "heron newt"), ("a an", "otter"), (None, "otter")], S.token_f1) == [0.5, 0.0, 0.0]
    assert over(["x {\"k\": [1, {\"j\": 2}]} y", "~~~", "```\n{\"k\": null}\n```", None], S.json_object) == ['{"k": [1, {"j": 2}]}', "{}", '{"k": null}', "{}"]
    assert over(["https://github.com/zoo/otter/issues/3", "https://www.zoo.io/otter/x", "github.com/zoo/otter", None], S.full_name)[1::2] == [None, None]
    assert over(["https://github.com/zoo/otter.git"], S.full_name) == ["zoo/otter"]
    assert over(["x/y/z", "one", "k/l//"], S.last_segments)[:2] == ["y/z", None]
    assert [tuple(x) for x in over(["zoo/pond/Otter.Photo.PNG", "..hidden", "zoo/heron"], S.path_parts)] == [("Otter.Photo.PNG", ".png", "zoo/pond", False, "zoo"), ("..hidden", ".hidden", ".", True, "(root)"), ("heron", "", "zoo", False, "zoo")]
    assert over([("one  two\n", "one two"), ("abcdef", "abcxyz"), ("", "")], S.seq_ratio)[:2] == [1.0, 0.5]


def test_topic_labels(spark):
    rows = spark.createDataFrame([(-1, "any", ["otter"]), (4, "Pond Life", ["otter", "", "heron"]), (5, None, ["grey heron", "otter"]), (6, None, [])], "t int, n string, w array<string>")
    got = [tuple(r["r"]) for r in rows.select(S.topic_label(F.col("n"), F.col("w"), F.col("t")).alias("r")).collect()]
    assert got[1:] == [("Pond Life", "otter, heron"), ("Grey Heron | Otter", "grey heron, otter"), ("Topic 6", "")] and got[0][0] == "Unassigned"


def test_provenance_of_own_samples(over):
    kind = lambda parts: lambda s, i: S.provenance(s, i, parts)["note"]
    rows = [("by the Otter team", None), ("x", "SEC_JS_CWE3"), ("Semgrep, Otter", None), ("x", None)]
    own, other = over(rows, kind(("Otter",))), over(rows, kind(()))
    assert own[0] == own[1] == own[2] == other[1] and other[0] == other[3] == own[3] and other[2] != own[2]


def test_functions_from_sql(spark):
    """Each SQL function gives what the column function gives."""
    from lodemill.functions import sql

    names = sql.register(spark)
    assert len(names) == len(sql.FUNCTIONS) + len(sql.PYTHON) + 4
    texts = ["CWE-079 zoo/README.md", "pkg:npm/otter@1", "The heron is in the zoo and it's VULNERABLE (LLM3)", "A03:2021 9.5", '```json\n{"k": "it\\\\"}\n```', "docs/v1.2/en/k.md", "https://github.com/zoo/otter", "", None]
    rows = [(a, b, 9.1 * k, bool(k % 2), k) for k, a in enumerate(texts) for b in texts[::3]]
    df = spark.createDataFrame(rows, "a string, b string, d double, f boolean, n int").withColumn("t", F.timestamp_seconds(F.col("n") * 90_000))
    df.createOrReplaceTempView("sql_rows")
    of = {"string": ["a", "b", "a"], "double": ["d"], "boolean": ["f"], "int": ["n", "n"], "timestamp": ["t", "t"]}
    for name, (function, parameters) in sql.FUNCTIONS.items():
        used = {k: list(v) for k, v in of.items()}
        columns = [used[p.split()[1]].pop(0) for p in parameters.split(",")]
        want = df.select(function(*map(F.col, columns)).alias("r")).collect()
        assert spark.sql(f"SELECT {name}({', '.join(columns)}) AS r FROM sql_rows").collect() == want, name
    assert spark.sql("SELECT strip_comments('x = 1 # y', 'python') AS r").first()["r"] == "x = 1"
    assert spark.sql("SELECT function FROM py_functions('def f(): pass')").first()["function"] == "f"


def test_comments():
    from lodemill.functions.comments import without_comments

    assert without_comments("a = 'x # y'  # z\n/* b\nc */ d <!-- e --> f // g", "python") == "a = 'x # y'\n d  f // g"
    assert without_comments("u = \"http://z\"; // don\nv = `#`", "javascript") == 'u = "http://z";\nv = `'
    # A quote in a comment begins a literal, up to the next one; the literal goes with the comment that it stands in.
    assert without_comments("a # don't\nb # keep\nc = 'd'", "python") == "a"
    assert without_comments(None, None) == ""
