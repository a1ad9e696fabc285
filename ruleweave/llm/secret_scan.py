"""Secret scan: credential parts found by pattern and linked within scopes, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ruleweave.llm.common import cut, free


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _keyed(words: str, value: str) -> str:
    names = "|".join(either_case(word) for word in words.split())
    return rf"""(?:{names})["']?\x20*[:=]\x20*["']?({value})"""


ASSIGN = _keyed("password passwd secret token api_?key", "[A-Za-z0-9+/_.=-]+")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # maximal runs, so the same spans as dropping shorter runs of [0-9a-f]+
ACCOUNT = _keyed("username login client_?id account access_?key_?id", "[A-Za-z0-9@_.-]+")
ENDPOINT = r"""[a-z][a-z0-9+.]*://[^\x20\x09-\x0D"'<>]+"""
BARE = "[A-Za-z0-9+/_-]{24,}={0,2}"

#: kind: (pattern, group whose length counts, least length); the first three are reported by themselves.
KINDS = {
    "assign": (ASSIGN, 1, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16),
    "account": (ACCOUNT, 1, 4), "endpoint": (ENDPOINT, 0, 10), "bare": (BARE, 0, 24),
}
BASE = ("assign", "access", "hex")
#: Code points around a part within which its complements count.
SCOPE = 400


def _mixed(value: Column) -> Column:
    """A bare token is a candidate only with digits and both letter cases."""
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def _matches(kind: str, number: int) -> Column:
    """(kind number, length of the text before, length of the match, holds) for each match, in order."""
    pattern, group, least = KINDS[kind]
    text, find = F.col("text"), F.lit(pattern)
    found = F.regexp_extract_all(text, find, F.lit(0))
    counted = found if group == 0 else F.regexp_extract_all(text, find, F.lit(group))
    gaps = F.split(text, pattern, -1)

    def one(match: Column, i: Column) -> Column:
        value = F.element_at(counted, i + 1) if group else match
        holds = F.length(value) >= least
        if kind == "bare":
            holds = holds & _mixed(match)
        return F.struct(
            F.lit(number).alias("kind_no"), F.length(F.element_at(gaps, i + 1)).alias("gap"),
            F.length(match).alias("size"), holds.alias("holds"),
        )

    empty = F.array().cast("array<struct<kind_no:int,gap:int,size:int,holds:boolean>>")
    return F.when(text.rlike(pattern), F.transform(found, one)).otherwise(empty)


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts whose complements lie within ``scope`` code points.

    Spans are dealt by (row, bucket of ``scope`` code points) and meet those of the next buckets, an
    interval join on an equality: a long document is many small groups. A bare token needs an access
    or account identifier, an account needs a secret, an endpoint needs both. A bare token that
    overlaps a base span is that span already.
    """
    spans = parts.withColumn("bucket", F.floor(F.col("start") / scope))
    weak = spans.filter(~F.col("kind").isin(*BASE)).select("row", "kind", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)).alias("bucket"))
    covers = spans.withColumn("first", F.col("bucket")).withColumn("bucket", F.explode(F.sequence("bucket", F.floor((F.col("end") - 1) / scope))))
    role = F.when(F.col("kind").isin("access", "account"), "identifier").when(F.col("kind").isin("assign", "bare"), "secret").otherwise("other")
    other = covers.select("row", "bucket", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("kind").alias("o_kind"), role.alias("o_role"))
    near = weak.join(other, ["row", "bucket"]).filter((F.col("o_start") < F.col("end") + scope) & (F.col("o_end") > F.col("start") - scope))
    overlap = (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start"))
    apart = ~overlap
    facts = near.groupBy("row", "kind", "start", "end").agg(
        F.max(apart & (F.col("o_role") == "identifier")).alias("identifier"),
        F.max(apart & (F.col("o_role") == "secret")).alias("secret"),
        F.max(overlap & F.col("o_kind").isin(*BASE)).alias("known"),
        F.max(overlap & (F.col("o_kind") == "endpoint")).alias("inside"),
    )
    bare = (F.col("kind") == "bare") & F.col("identifier") & ~F.col("known") & ~F.col("inside")
    account = (F.col("kind") == "account") & F.col("secret") & ~F.col("known")
    endpoint = (F.col("kind") == "endpoint") & F.col("secret") & F.col("identifier")
    return facts.filter(bare | account | endpoint).select("row", "kind", "start", "end")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key (xxhash64 of the text) and spans.

    ``spans`` is an array of (start, kind_no, kind, end) in code points, end exclusive, ordered by
    start and kind; kinds assign, access and hex stand alone, account, endpoint and bare appear only
    with their complements in scope. A null text counts as empty and has no spans; a null doc_id
    stays null; repeated rows are scanned each by itself; other columns are ignored. The whole text
    is matched in one narrow pass, whose lengths alone are kept for the rest.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = F.concat(*[_matches(kind, number) for number, kind in enumerate(KINDS)])
    rows = cut(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), found.alias("found")))
    order = Window.partitionBy("row", "kind_no").orderBy("at")
    parts = rows.select("row", F.posexplode("found").alias("at", "m")).select("row", "at", "m.*")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).filter("holds")
    names = F.array(*[F.lit(kind) for kind in KINDS])
    parts = cut(parts.select("row", F.element_at(names, F.col("kind_no") + 1).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end"))
    kept = parts.filter(F.col("kind").isin(*BASE)).unionByName(_linked(parts, scope))
    span = F.struct("start", (F.array_position(names, F.col("kind")) - 1).alias("kind_no"), "kind", "end")
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(by_row.schema["spans"].dataType)
    return rows.select("row", "doc_id", "text_key").join(by_row, "row", "left").select("doc_id", "text_key", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    total = F.size("spans")
    counts = [(total - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return scanned.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``, all rows and columns kept; n_chars, if there, follows.

    Overlapping spans become one mark. Rows without spans keep their text as it is, null included.
    """
    own, same, spans, mine, done = free(docs, "hit_id", "hit_key", "hit_spans", "own_key", "redacted")
    hits = scan(docs, scope).filter(F.size("spans") > 0).select(F.col("doc_id").alias(own), F.col("text_key").alias(same), F.col("spans").alias(spans))
    hits = hits.dropDuplicates([own, same])
    text = F.col("text").cast("string")
    rows = docs.withColumn(mine, F.xxhash64(text))
    rows = rows.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(mine) == F.col(same)), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["at"].cast("int") + 1, (span["start"] - done["at"]).cast("int"))
        fresh = F.concat(done["out"], gap, F.lit(mark))
        over = span["start"] < done["at"]
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.when(over, done["out"]).otherwise(fresh).alias("out"))

    rows = rows.withColumn(done, F.when(F.col(same).isNotNull(), F.aggregate(spans, start, step)))
    rest = F.substring(text, F.col(done)["at"].cast("int") + 1, F.length(text))
    clean = F.when(F.col(done).isNull(), text).otherwise(F.concat(F.col(done)["out"], rest))
    result = rows.select(*[clean.alias("text") if name == "text" else F.col(name) for name in docs.columns])
    return result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else result
