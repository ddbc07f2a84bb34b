"""Commit attribution: rule tables compiled into one projection, without a shuffle or an explode.

Every rule set takes a flat view of a commit: ``message``, ``author_name``, ``author_email``,
``author_login``, ``committer_name``, ``committer_email``, ``committer_login`` and, for its pull
request, ``pr_number``, ``pr_title``, ``pr_body``, ``pr_user``, ``pr_labels`` (array) and
``pr_head_ref``; without one ``pr_number`` is null. Nulls are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.functions.regex import found
from lodemill.rules import attribution as R

CLUE = "struct<field:string,signal:string>"


def _clue(field: str | Column, signal: str | Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_col(field).alias("field"), as_col(signal).alias("signal"))


def _kept(clues: list[Column]) -> Column:
    return F.array_compact(F.array(*clues)) if clues else F.array().cast(f"array<{CLUE}>")


def _tried(rules: list[tuple[str, str]], fields: list[tuple[str, Column]], by_field: bool = False) -> list[Column]:
    """Clues of each rule on each field; rule by rule, or field by field."""
    pairs = [(f, r) for f in fields for r in rules] if by_field else [(f, r) for r in rules for f in fields]
    return [F.when(found(col, pattern), _clue(name, signal)) for (name, col), (pattern, signal) in pairs]


def _logins(patterns: list[str], kind: str) -> list[tuple[str, str]]:
    return [(p, f"{kind} regex '{p}'") for p in patterns]


def three_class_clues(prs: bool) -> dict[str, Column]:
    """Clues of c01 (``prs``: with the signals in the message) and of c02's baseline."""
    col = F.col
    actors = [("author_login", col("author_login")), ("committer_login", col("committer_login"))]
    emails = [("author_email", col("author_email")), ("committer_email", col("committer_email"))]
    names = [("author_name", col("author_name")), ("committer_name", col("committer_name"))]
    message = [("message", col("message"))]
    ai = _tried(_logins(R.ACTOR_AI_LOGINS, "AI"), actors, True) + _tried(R.ACTOR_AI_EMAILS, emails, True) + _tried(R.ACTOR_AI_NAMES, names, True) + _tried(R.ACTOR_AI_TRAILERS, message)
    if prs:
        ai += _tried(R.MESSAGE_PR_SIGNALS, [("pr_signal", col("message"))])
    bot = _tried(_logins(R.ACTOR_BOT_LOGINS, "Bot"), actors, True) + _tried(R.ACTOR_BOT_EMAILS, emails, True) + _tried(R.ACTOR_BOT_NAMES, names, True) + _tried(R.ACTOR_BOT_TRAILERS, message)
    return {"ai": _kept(ai), "bot": _kept(bot)}


def _three(commits: DataFrame, ai: Column, bot: Column, category: str, clues: str) -> DataFrame:
    first, second, none = R.THREE_CLASSES
    held = commits.withColumns({"__ai": ai, "__bot": bot})
    has_ai, has_bot = F.size("__ai") > 0, F.size("__bot") > 0
    return held.withColumns(
        {
            category: F.when(has_ai, first).when(has_bot, second).otherwise(none),
            clues: F.when(has_ai, F.col("__ai")).otherwise(F.col("__bot")),
        }
    ).drop("__ai", "__bot")


def c01(commits: DataFrame) -> DataFrame:
    """Three classes from the commit alone; the clues of the class that wins."""
    clues = three_class_clues(prs=True)
    return _three(commits, clues["ai"], clues["bot"], "category", "clues")


def c02(commits: DataFrame, prs: str = "prs") -> DataFrame:
    """Three classes without and with pull requests (``prs``: array of number, title, body, labels)."""
    base = three_class_clues(prs=False)

    def of_prs(rules: list[tuple[str, str]]) -> Column:
        def one(pr: Column) -> Column:
            text = F.concat_ws("\n", F.coalesce(pr["title"], F.lit("")), F.coalesce(pr["body"], F.lit("")), F.array_join(F.coalesce(pr["labels"], F.array().cast("array<string>")), " "))
            return F.array_compact(F.array(*[F.when(found(text, p), _clue(F.format_string("PR #%s", pr["number"].cast("string")), s)) for p, s in rules]))

        return F.flatten(F.transform(F.coalesce(F.col(prs), F.array()), one))

    first = _three(commits, base["ai"], base["bot"], "baseline_category", "baseline_clues")
    held = first.withColumns({"__ai": of_prs(R.PR_TEXT_AI), "__bot": of_prs(R.PR_TEXT_BOT)})
    ai, bot, none = R.THREE_CLASSES
    is_ai = (F.col("baseline_category") == ai) | (F.size("__ai") > 0)
    is_bot = (F.col("baseline_category") == bot) | (F.size("__bot") > 0)
    empty = F.array().cast(f"array<{CLUE}>")
    return held.withColumns(
        {
            "multimodal_category": F.when(is_ai, ai).when(is_bot, bot).otherwise(none),
            "multimodal_clues": F.when(is_ai, F.concat("baseline_clues", "__ai")).when(is_bot, F.concat("baseline_clues", "__bot")).otherwise(empty),
        }
    ).drop("__ai", "__bot")


def _pr_fields() -> dict[str, Column]:
    has = F.col("pr_number").isNotNull()
    part = lambda c: F.when(has, F.coalesce(F.col(c), F.lit("")))
    labels = F.when(has, F.coalesce(F.col("pr_labels"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return {"body": part("pr_body"), "user": part("pr_user"), "ref": part("pr_head_ref"), "labels": labels, "label_text": F.array_join(labels, " ")}


def _either(rules: list[tuple[str, str]], fields: list[Column]) -> list[Column]:
    """One clue of a rule if any field has it."""
    out = []
    for pattern, signal in rules:
        hit = found(fields[0], pattern)
        for f in fields[1:]:
            hit = hit | found(f, pattern)
        out.append(F.when(hit, _clue("PR", signal)))
    return out


def four_class_clues(rules: str) -> dict[str, Column]:
    """Git clues and pull-request clues by class for c03, c04, c05 or c06; ``pr`` has the latter in the order found."""
    pr = _pr_fields()
    col = F.col
    message, author = ("Commit Message", col("message")), ("Author Name", col("author_name"))
    login, committer, email = ("Actor Login", col("author_login")), ("Committer Login", col("committer_login")), ("Author Email", col("author_email"))
    if rules == "c03":
        git = {
            "interactive": _tried(R.LOOSE_TRAILERS, [message]) + _tried(R.LOOSE_TRAILERS, [author]),
            "autonomous": _tried(R.AUTONOMOUS_V1, [login, email, message]),
            "devops": _tried(R.DEVOPS_V1, [login, email]),
        }
        own = {
            "interactive": _either(R.PR_INTERACTIVE_V1, [pr["body"], pr["label_text"]]),
            "autonomous": _either(R.PR_AUTONOMOUS_V1, [pr["user"], pr["label_text"], pr["body"]]),
            "devops": _either(R.PR_DEVOPS_V1, [pr["user"], pr["label_text"]]),
        }
        in_order = own["interactive"] + own["autonomous"] + own["devops"]
        return {k: _kept(git[k]) for k in git} | {f"pr_{k}": _kept(own[k]) for k in own} | {"pr": _kept(in_order)}
    trailers, autonomous = {"c04": (R.LOOSE_TRAILERS, R.AUTONOMOUS_V2), "c05": (R.STRICT_TRAILERS, R.AUTONOMOUS_V3), "c06": (R.MIXED_TRAILERS, R.AUTONOMOUS_V4)}[rules]
    git = {"interactive": _tried(trailers, [message, author]), "autonomous": _tried(autonomous, [login, committer, email, message]), "devops": _tried(R.DEVOPS_V2, [login, committer, email])}
    if rules == "c04":
        body, labels, user, ref = ("PR Body", pr["body"]), ("PR Labels", pr["label_text"]), ("PR Author", pr["user"]), ("PR Branch", pr["ref"])
        own = {"interactive": _tried(R.PR_INTERACTIVE_V2, [body, labels]), "autonomous": _tried(R.PR_AUTONOMOUS_V2, [user, labels, body, ref]), "devops": _tried(R.PR_DEVOPS_V2, [user, labels, ref])}
        in_order = own["interactive"] + own["autonomous"] + own["devops"]
        return {k: _kept(git[k]) for k in git} | {f"pr_{k}": _kept(own[k]) for k in own} | {"pr": _kept(in_order)}
    boxes, marks = (R.CHECKBOXES_V3, R.WATERMARKS_V3) if rules == "c05" else (R.CHECKBOXES_V4, R.WATERMARKS_V4)
    lowered = F.transform(pr["labels"], F.lower)
    said = {"interactive": "'%s'", "autonomous": "'%s' (Autonomous Agent)", "devops": "'%s'"}

    def by_label(kinds: list[str]) -> Column:
        def one(label: Column) -> Column:
            return F.array_compact(F.array(*[F.when(label.isin(R.PR_LABELS[k]), _clue("PR Label", F.format_string(said[k], label))) for k in kinds]))

        return F.flatten(F.transform(lowered, one))

    ticked = _tried(boxes, [("PR Checkbox", pr["body"])])
    marked = [(("autonomous" if "Sweep" in s or "Devin" in s else "interactive"), c) for (_, s), c in zip(marks, _tried(marks, [("PR Body", pr["body"])]), strict=True)]

    def first_of(rules_: list[tuple[str, Column, Column]]) -> dict[str | None, Column]:
        """Only the first rule that holds gives a clue; None: whichever class it is of."""
        out = {}
        for kind in (None, "interactive", "autonomous", "devops"):
            chain = None
            for k, test, clue in rules_:
                value = clue if kind in (None, k) else F.lit(None).cast(CLUE)
                chain = F.when(test, value) if chain is None else chain.when(test, value)
            out[kind] = chain
        return out

    author_of = first_of([(k, found(pr["user"], p), _clue("PR Author", s if s else pr["user"])) for k, p, s in R.PR_AUTHORS])
    branch_of = first_of([(k, F.coalesce(F.startswith(F.lower(pr["ref"]), F.lit(p)), F.lit(False)), _clue("PR Branch", s)) for k, p, s in R.PR_BRANCHES])
    own = {k: F.concat(by_label([k]), _kept((ticked if k == "interactive" else []) + [c for kind, c in marked if kind == k] + [author_of[k], branch_of[k]])) for k in said}
    in_order = F.concat(by_label(list(said)), _kept(ticked + [c for _, c in marked] + [author_of[None], branch_of[None]]))
    return {k: _kept(git[k]) for k in git} | {f"pr_{k}": own[k] for k in own} | {"pr": in_order}


def four_classes(commits: DataFrame, rules: str = "c06") -> DataFrame:
    """``baseline_category``, ``multimodal_category``, their ``baseline_clues`` and ``clues``, and all ``pr_clues``."""
    parts = four_class_clues(rules)
    held = commits.withColumns({f"__{k}": v for k, v in parts.items()})

    def choose(lists: dict[str, Column], what: dict[str, Column], other: Column) -> Column:
        out = None
        for kind, _ in R.CLASSES:
            test = F.size(lists[kind]) > 0
            out = F.when(test, what[kind]) if out is None else out.when(test, what[kind])
        return out.otherwise(other)

    base = {k: F.col(f"__{k}") for k, _ in R.CLASSES}
    both = {k: F.concat(f"__{k}", f"__pr_{k}") for k, _ in R.CLASSES}
    names = {k: F.lit(v) for k, v in R.CLASSES}
    empty = F.array().cast(f"array<{CLUE}>")
    return held.withColumns(
        {
            "baseline_category": choose(base, names, F.lit(R.HUMAN)),
            "baseline_clues": choose(base, base, empty),
            "multimodal_category": choose(both, names, F.lit(R.HUMAN)),
            "clues": choose(both, both, empty),
            "pr_clues": F.col("__pr"),
        }
    ).drop(*[f"__{k}" for k in parts])


def clue_text(clues: str, number: str = "pr_number") -> Column:
    """Clues as one text: ``field: signal`` joined by ``; ``, pull-request fields with the number; None if there are none."""

    def one(clue: Column) -> Column:
        field = F.when(F.startswith(clue["field"], F.lit("PR ")), F.concat(F.lit("PR #"), F.col(number).cast("string"), F.substring(clue["field"], 3, 99))).otherwise(clue["field"])
        return F.concat(field, F.lit(": "), clue["signal"])

    return F.when(F.size(clues) > 0, F.array_join(F.transform(clues, one), "; ")).otherwise("None")


def commit_rows(commits: DataFrame) -> DataFrame:
    """The production set's 30 columns from commits that are linked with their pull requests.

    Needs ``repo_alias``, ``repo_name``, ``repo_url``, ``sha`` and ``commit_date`` besides the flat view.
    """
    done = four_classes(commits, "c06")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ai = F.col("multimodal_category").isin("INTERACTIVE_AI_COAUTHORED", "AUTONOMOUS_AI_AGENT")
    flag = lambda c: c.cast("int")
    raw = F.btrim(text("message"), F.lit(" \t\n\r\x0b\x0c"))
    has = F.col("pr_number").isNotNull()
    pr = lambda c: F.when(has, text(c)).otherwise("")
    return done.select(
        "repo_alias",
        "repo_name",
        "repo_url",
        F.col("sha").alias("commit_sha"),
        F.substring("sha", 1, 7).alias("commit_short_sha"),
        F.concat(F.lit("https://github.com/"), "repo_name", F.lit("/commit/"), "sha").alias("commit_url"),
        text("commit_date").alias("commit_date"),
        text("author_name").alias("author_name"),
        text("author_email").alias("author_email"),
        text("author_login").alias("author_login"),
        text("committer_login").alias("committer_login"),
        F.split_part(raw, F.lit("\n"), F.lit(1)).alias("commit_title"),
        raw.alias("commit_message"),
        has.alias("has_pr"),
        F.coalesce(F.col("pr_number").cast("string"), F.lit("")).alias("pr_number"),
        F.when(has, F.concat(F.lit("https://github.com/"), "repo_name", F.lit("/pull/"), F.col("pr_number").cast("string"))).otherwise("").alias("pr_url"),
        pr("pr_title").alias("pr_title"),
        pr("pr_user").alias("pr_author_login"),
        F.when(has, F.array_join(F.coalesce("pr_labels", F.array().cast("array<string>")), "; ")).otherwise("").alias("pr_labels"),
        pr("pr_head_ref").alias("pr_head_ref"),
        F.when(has, F.btrim(F.translate(F.substring(text("pr_body"), 1, 200), "\n", " "), F.lit(" \t\r\x0b\x0c"))).otherwise("").alias("pr_body_excerpt"),
        "baseline_category",
        "multimodal_category",
        flag(ai).alias("is_ai_assisted"),
        flag(F.col("multimodal_category") == "AUTONOMOUS_AI_AGENT").alias("is_autonomous_agent"),
        flag(F.col("multimodal_category") == "DETERMINISTIC_DEVOPS_BOT").alias("is_devops_bot"),
        flag(F.col("multimodal_category") == R.HUMAN).alias("is_pure_human"),
        flag((F.col("baseline_category") == R.HUMAN) & ai).alias("uncovered_by_pr"),
        clue_text("clues").alias("detection_clues"),
        clue_text("pr_clues").alias("pr_clues"),
    )
