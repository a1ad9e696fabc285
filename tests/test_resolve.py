"""Title matching, unique programmes and gates."""

import itertools
import random

from pyspark.sql import functions as F

from ruleweave.operators import resolve as r

PROFILES = [
    (11, "Всероссийская олимпиада школьников «Звёздный путь»", "астрономия", 1),
    (12, "Всероссийская олимпиада школьников «Звёздный путь»", "информатика", 1),
    (13, "Олимпиада школьников «Мосты и реки»", "география", 2),
    (14, "Открытая олимпиада школьников", "информатика", 2),
    (15, "Олимпиада школьников «Мосты и реки»", "ИИ", 2),
]


def match(spark, texts):
    profiles = spark.createDataFrame(PROFILES, "profile_id long, title string, profile_title string, level int")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: (x.match_status, x.match_reason, x.matched_profile_id) for x in r.catalogue_match(df, "id", "text", profiles).collect()}
    options = {}
    for x in r.expanded(*r.alternatives(df, "id", "text", profiles)).collect():
        options.setdefault(x.id, set()).add(x.profile_id)
    return [got[i] for i in range(len(texts))], options


def test_outcomes_and_reasons(spark):
    got, options = match(
        spark,
        [
            "«Звездный путь» | II | Астрономия | 100 баллов",
            "Олимпиада «Звёздный путь» даёт право",
            "Мосты и реки: приём ИИ",
            "Победителям по информатике",
            "Сибирская открытая олимпиада школьников | информатика",
            "Звёздный путь, информатика и астрономия",
            "Звёздный путьь | астрономия",
            "",
        ],
    )
    assert got == [
        ("resolved", "title_and_profile", 11),
        ("ambiguous", "title_has_multiple_profiles", None),
        ("ambiguous", "title_has_multiple_profiles", None),
        ("unresolved", "no_rsosh_title", None),
        ("unresolved", "no_rsosh_title", None),
        ("ambiguous", "multiple_profiles_in_candidate", None),
        ("unresolved", "no_rsosh_title", None),
        ("unresolved", "no_rsosh_title", None),
    ]
    assert options[1] == {11, 12} and options[2] == {13, 15} and options[5] == {11, 12}


def test_join_equals_brute_force(spark):
    random.seed(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    phrase = lambda low, high: " ".join(random.choices(words, k=random.randint(low, high)))
    texts, titles = [phrase(1, 30) for _ in range(60)], [phrase(1, 12) for _ in range(60)]
    titles += [t for t in texts[:5] if len(t.split()) > 9]
    left = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    right = spark.createDataFrame(list(enumerate(titles)), "k long, title string")
    aliases = r.alias_table(right, "k", "title", prefixes=(), generic=())
    got = {(x.text_key, x.title_key) for x in r.title_hits(left, "id", "text", aliases).collect()}
    want = {
        (i, k) for (i, a), (k, b) in itertools.product(enumerate(texts), enumerate(titles))
        if len(b.replace(" ", "")) >= 8 and f" {b} " in f" {a} "
    }
    assert got == want and want


def test_a_title_that_all_texts_start_with(spark):
    """An alias start in 100,000 texts: the rare word decides, and what is shuffled is little more than the hits."""
    texts = spark.range(100_000).select("id", F.concat(F.lit("alpha beta gamma delta "), F.when(F.col("id") % 1000 == 0, "omega").otherwise("other"), F.lit(" end")).alias("text"))
    titles = spark.createDataFrame([(1, "alpha beta gamma delta omega"), (2, "alpha beta gamma delta nowhere"), (3, "beta gamma delta other end")], "k long, title string")
    aliases = r.alias_table(titles, "k", "title", prefixes=(), generic=())
    counts = r.token_counts(texts.select("id", F.split("text", " ").alias("tokens")), aliases)
    assert {(x.title_key, x.size) for x in r.anchored(aliases, counts).collect()} == {(1, 3), (3, 3)}
    got = r.title_hits(texts, "id", "text", aliases).groupBy("title_key").count().collect()
    assert {(x.title_key, x["count"]) for x in got} == {(1, 100), (3, 99_900)}


def test_hot_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(r, "HOT", 3)
    texts = spark.range(40).select("id", F.lit("one alpha beta two alpha beta three").alias("text"))
    titles = spark.createDataFrame([(1, "alpha beta two"), (2, "alpha beta three"), (3, "alpha beta four")], "k long, title string")
    got = r.title_hits(texts, "id", "text", r.alias_table(titles, "k", "title", prefixes=(), generic=()))
    assert sorted(map(tuple, got.collect())) == [(i, k) for i in range(40) for k in (1, 2)]


def test_alternatives_of_a_popular_title_are_a_class(spark):
    profiles = spark.range(100_000).select(
        F.col("id").alias("profile_id"), F.lit("Олимпиада «Большой мост»").alias("title"), F.concat(F.lit("профиль номер "), "id").alias("profile_title"), F.lit(1).alias("level")
    )
    texts = spark.range(500).select("id", F.concat(F.lit("Олимпиада Большой мост, право "), F.col("id")).alias("text"))
    choices, classes = r.alternatives(texts, "id", "text", profiles)
    assert choices.count() == 500 and choices.filter("name IS NOT NULL").count() == 0
    assert classes.count() == 100_000 and r.expanded(choices.filter("id = 7"), classes).count() == 100_000


def test_no_texts_and_no_titles(spark):
    none = spark.createDataFrame([], "id long, text string")
    titles = spark.createDataFrame([(1, "alpha beta gamma"), (2, None)], "k long, title string")
    aliases = r.alias_table(titles, "k", "title", prefixes=(), generic=())
    assert r.title_hits(none, "id", "text", aliases).count() == 0
    some = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (None, "x alpha beta gamma")], "id long, text string")
    assert r.title_hits(some, "id", "text", aliases.filter("false")).count() == 0
    assert sorted(map(tuple, r.title_hits(some, "id", "text", aliases).collect()), key=str) == [(1, 1), (None, 1)]


def test_programme_resolution(spark):
    programmes = spark.createDataFrame(
        [
            (1, 1, "01.03.02", "Прикладная математика", "named_verified"), (1, 2, "09.03.04", "Инженерия", "named_verified"),
            (1, 3, "15.03.01", "Направление 15.03.01", "code_only"), (1, 4, "15.03.01", "Станки", "named_verified"),
            (1, 5, "20.03.01", "Прикладная математика", "named_verified"), (1, 6, "30.03.01", "a", "code_only"), (1, 7, "30.03.01", "b", "code_only"),
            (2, 8, "09.03.04", "Инженерия", "named_verified"),
        ],
        "loc long, programme_id long, external_code string, name string, catalogue_status string",
    )
    asked = ["09.03.04", "09.03", "прикладная  Математика", "15.03.01", "30.03.01", "«Станки»", "20.03.01 "]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(asked)], "loc long, id int, selector string")
    got = {x.id: x.programme_id for x in r.unique_programme(df, "selector", programmes, ["loc"]).collect()}
    assert got == {0: 2, 1: None, 2: None, 3: 3, 4: None, 5: 4, 6: 5}


ODD = ["12.03.04", " 12.03.04", "12.03.04\n", "12 03 04", "12-03-04", "12.05.04", "Химия", "химия ", "«Химия»", "", None, "Ёлка", "елка", "\u00a012.05.04\u00a0"]


def test_scopes_follow_from_the_hits_of_the_resolution(spark):
    draw = random.Random(7)
    rows = [
        (draw.choice([1, 2, None]), n, draw.choice(ODD), draw.choice(ODD), draw.choice(["code_only", "named_verified", None])) for n in range(30)
    ]
    programmes = spark.createDataFrame(rows, "loc long, programme_id long, external_code string, name string, catalogue_status string")
    asked = [(loc, n, selector) for n, (loc, selector) in enumerate(itertools.product([1, 2, 3, None], ODD))]
    df = spark.createDataFrame(asked, "loc long, id int, selector string")
    for keep in ("true", "catalogue_status = 'code_only'", "programme_id < 6", "false"):
        some = programmes.filter(keep)
        found = r.unique_programme(df, "selector", some, ["loc"], keep=["_code_hits", "_title_hits"])
        named = found.filter("programme_id IS NULL").withColumn("named", F.when(r.direction_code("selector").isNull(), r.strip("selector")))
        named = named.withColumn("named", F.nullif("named", F.lit("")))
        got = r.unknown_scopes(named, "selector", "named", ["loc"], ["id"]).collect()
        assert sorted(got, key=str) == sorted(r.missing_scopes(named, "selector", "named", some, ["loc"], ["id"]).collect(), key=str)
        assert got


def test_gate_names_the_first_reason(spark):
    columns = "adapter string, kind string, confidence int, loc long, p string, o string, f string, d string, b string"
    good = ("strict-hse-2026-v1", "strict_table_row", 100, 4, "01.03.02", "t", "f", "winner", "bvi")
    swap = lambda **kw: tuple(kw.get(n.split()[0], v) for n, v in zip(columns.split(", "), good))
    cases = [
        (good, None),
        (swap(adapter="requests-bs4-keyword-v1", kind="table_row"), "generic_source_without_explicit_table_proof"),
        (swap(adapter="requests-bs4-keyword-v1", kind="automatic_explicit_table_row"), None),
        (swap(adapter=None), None), (swap(confidence=72), "strict_confidence_required"), (swap(loc=None), "missing_location_scope"),
        (swap(f=""), "missing_explicit_identity"), (swap(d="finalist"), "missing_explicit_diploma_status"),
        (swap(b="individual_points"), "missing_explicit_benefit_kind"),
    ]
    df = spark.createDataFrame([case for case, _ in cases], columns)
    reason = r.gate_reason(*[F.col(c) for c in ("adapter", "kind", "confidence", "loc")], [F.col("p"), F.col("o"), F.col("f")], F.col("d"), F.col("b"))
    assert [x[0] for x in df.coalesce(1).select(reason).collect()] == [want for _, want in cases]


def test_named_scope_comes_from_one_row_kind_only(spark):
    df = spark.createDataFrame(
        [("strict-msu-2026-v2", "msu_programme_table_row", "Механика"), ("strict-msu-2026-v2", "msu_programme_table_row", "Группа программ «Био»"),
         ("strict-msu-2026-v2", "table_row", "Механика"), ("strict-mipt-2026-v2", "msu_programme_table_row", "Механика"),
         ("strict-msu-2026-v2", "msu_programme_table_row", "01.03.02")],
        "a string, k string, p string",
    ).coalesce(1)
    got = [x[0] for x in df.select(r.named_scope(F.col("a"), F.col("k"), F.col("p"))).collect()]
    assert got == ["Механика", None, None, None, None]
