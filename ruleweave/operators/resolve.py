"""Exact resolution of text to catalogue entries; everything ambiguous fails closed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.functions.text import contains_any, direction_code, fold_tokens, let, level_of_code, strip
from ruleweave.operators.ordered import keep_first
from ruleweave.session import cut_lineage, stored

#: Tokens of an anchor, most bits of a filter (a quarter of a megabyte), and occurrences beyond which an anchor is dealt out.
RUN, BITS, HOT = 3, 1 << 21, 10_000
#: Parts of a hash that each mark a bit of a filter, and the bits of a part: three of 21 are most of a long.
PROBES, PART = 3, 21


def as_they_lie(rows: DataFrame) -> DataFrame:
    return rows


def title_aliases(title: Column | str, prefixes: Sequence[str] = vocab.TITLE_PREFIXES) -> Column:
    """Folded title and its forms without a generic prefix, as far as those stay specific."""
    full = fold_tokens(title)
    shorts = []
    for prefix in prefixes:
        short = F.trim(F.substr(full, F.lit(len(prefix) + 1)))
        usable = (
            F.startswith(full, F.lit(prefix))
            & (F.length(short) >= vocab.MIN_ALIAS_LENGTH)
            & F.contains(short, F.lit(" "))
        )
        shorts.append(F.when(usable, short))
    return F.array_distinct(F.array_compact(F.array(full, *shorts)))


def is_specific(alias: Column, generic: Sequence[str] = vocab.GENERIC_TITLE_WORDS) -> Column:
    """At least eight letters outside the generic competition words."""
    own = F.filter(F.split(alias, " "), lambda word: ~word.isin(*generic)) if generic else F.split(alias, " ")
    return F.length(F.array_join(own, "")) >= vocab.MIN_DISTINCTIVE


def alias_table(
    titles: DataFrame, key: str, title: str, scope: Sequence[str] = (), prefixes: Sequence[str] = vocab.TITLE_PREFIXES,
    generic: Sequence[str] = vocab.GENERIC_TITLE_WORDS,
) -> DataFrame:
    """One row per (title, specific alias)."""
    return titles.select(
        *scope, F.col(key).alias("title_key"), F.explode(title_aliases(title, prefixes)).alias("alias")
    ).filter(is_specific(F.col("alias"), generic))


def bit_filter(hashes: DataFrame, column: str) -> Callable[[Column], Column]:
    """Test whether a value may be among a column of hashes: a Bloom filter of at most ``BITS`` bits.

    It takes 64 bits for each hash up to that, so the constant that goes into the plan, and what the
    driver reads for it, is bounded whatever the table holds; beyond that it lets more through. Each hash
    marks a bit by each of its ``PROBES`` parts, so that one foreign value in some 10,000 passes, at 16 bits
    for each hash one in 200.
    """
    distinct = hashes.agg(F.approx_count_distinct(column).alias("n")).first()["n"]
    bits = min(BITS, max(64, 1 << (64 * int(distinct)).bit_length()))

    def probes(value: Column) -> list[Column]:
        return [F.pmod(F.shiftrightunsigned(value, part * PART), F.lit(bits)) for part in range(PROBES)]

    marked = hashes.select(F.explode(F.array(*probes(F.col(column)))).alias("bit")).filter("bit IS NOT NULL")
    held = marked.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(_mask(F.col("bit"))).alias("bits"))
    words = [0] * (bits // 64)
    for row in held.collect():
        words[row["word"]] = row["bits"]
    marks = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to a constant

    def holds(value: Column) -> Column:
        tests = [F.get(marks, F.shiftright(at, 6).cast("int")).bitwiseAND(_mask(at)) != 0 for at in probes(value)]
        return reduce(and_, tests)

    return holds


def rows_of(rows: DataFrame, keys: Sequence[str], some: DataFrame) -> DataFrame:
    """Rows whose keys are among some; most others are filtered before the shuffle. ``some`` is read three times."""
    may_be = bit_filter(some.select(F.xxhash64(*keys).alias("key")), "key")
    return rows.filter(may_be(F.xxhash64(*keys))).join(some, [*keys], "left_semi")


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))


def token_counts(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """(token, n): in how many texts each token stands that aliases hold; others are filtered before the shuffle."""
    words = aliases.select(F.explode(F.split("alias", " ")).alias("token")).select(F.xxhash64("token").alias("h"))
    known = bit_filter(words, "h")
    mine = F.filter(F.array_distinct("tokens"), lambda token: known(F.xxhash64(token)))
    return tokens.select(F.explode(mine).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def anchored(aliases: DataFrame, counts: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Aliases with the hash and size of their rarest run of tokens, by the rarest token in it.

    An alias with a token that no text has is in no text and is left out.
    """
    placed = aliases.select(*scope, "title_key", "alias", F.posexplode(F.split("alias", " ")).alias("i", "token"))
    known = placed.join(counts, "token", "left").select(*scope, "title_key", "alias", F.struct("i", F.coalesce("n", F.lit(0)).alias("n")).alias("count"))
    ranked = known.groupBy(*scope, "title_key", "alias").agg(F.transform(F.sort_array(F.collect_list("count")), lambda x: x["n"]).alias("counts"))
    ranked = ranked.filter(F.array_min("counts") > 0).withColumn("size", F.least(F.size("counts"), F.lit(RUN)))
    starts = F.sequence(F.lit(1), F.size("counts") - F.col("size") + 1)
    best = F.array_min(F.transform(starts, lambda i: F.struct(F.array_min(F.slice("counts", i, F.col("size"))).alias("n"), i.alias("at"))))
    run = F.array_join(F.slice(F.split("alias", " "), best["at"], F.col("size")), " ")
    return ranked.select(*scope, "title_key", "alias", "size", F.xxhash64(run).alias("anchor"))


def title_hits(
    texts: DataFrame, text_key: str, text: str, aliases: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Distinct pairs (text, title) where an alias occurs in the text on word boundaries.

    Both sides are folded to single-space tokens, so presence means: the alias is a run of tokens of
    the text. Every alias is anchored at its rarest run, by the texts' own token counts. A text's runs
    of those sizes pass a Bloom filter of the anchors inside the row, so that little more than the hits
    is shuffled: the anchor's hash and the tokens around it, as many as the longest alias has, in which
    the alias is then looked for. Anchors with more than ``HOT`` occurrences are dealt out by text,
    their aliases once for each part.
    """
    aliases = cut_lineage(aliases.select(*scope, "title_key", "alias").distinct())
    tokens = texts.select(*scope, F.col(text_key).alias("text_key"), F.split(fold_tokens(text), " ").alias("tokens"))
    rare = cut_lineage(anchored(aliases, token_counts(tokens, aliases), scope))
    wanted = bit_filter(rare.select("anchor"), "anchor")
    bounds = rare.agg(F.max(F.size(F.split("alias", " "))).alias("longest"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    longest, sizes = F.lit(bounds["longest"] or 0), F.array(*[F.lit(size) for size in bounds["sizes"]]).cast("array<int>")  # of 1 to RUN

    def runs(size: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("tokens")), lambda i: i + size - 1 <= F.size("tokens"))
        found = F.transform(starts, lambda i: F.struct(F.xxhash64(F.array_join(F.slice("tokens", i, size), " ")).alias("anchor"), i.alias("at")))
        return F.filter(found, lambda run: wanted(run["anchor"]))

    def seen(run: Column) -> Column:
        first = F.greatest(run["at"] - longest, F.lit(1))
        near = F.slice("tokens", first, run["at"] - first + longest + RUN)
        return F.struct(run["anchor"].alias("anchor"), F.concat(F.lit(" "), F.array_join(near, " "), F.lit(" ")).alias("near"))

    found = F.array_distinct(F.transform(F.flatten(F.transform(sizes, runs)), seen))
    spots = cut_lineage(tokens.select(*scope, "text_key", F.explode(found).alias("spot")).select(*scope, "text_key", "spot.anchor", "spot.near"))
    hot = spots.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    most = hot.agg(F.max("n")).first()[0]
    is_hot, parts = bit_filter(hot, "anchor")(F.col("anchor")), -(-most // HOT) if most else 1
    part = F.pmod(F.xxhash64("text_key", "near"), F.lit(parts)).cast("int")
    dealt = spots.withColumn("part", F.when(is_hot, part).otherwise(F.lit(0)))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    met = dealt.join(rare.withColumn("part", F.explode(every)), [*scope, "anchor", "part"])
    held = met.filter(F.contains("near", F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    return held.select(*scope, "text_key", "title_key").distinct()


GRAM = vocab.MIN_PROFILE_LENGTH


def profile_names(profiles: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Profiles counted per folded title and folded profile name."""
    return profiles.groupBy(
        *scope, fold_tokens("title").alias("title_key"), fold_tokens("profile_title").alias("name")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("profile_id", "level")).alias("first")
    )


def hit_pairs(
    texts: DataFrame, key: str, text: str, titles: DataFrame, scope: Sequence[str], prefixes: Sequence[str], generic: Sequence[str],
) -> DataFrame:
    """The pairs of ``title_hits``, found once: several steps use them."""
    return cut_lineage(title_hits(texts, key, text, alias_table(titles, "title_key", "title_key", scope, prefixes, generic), scope))


def letter_grams(folded: Column | str) -> Column:
    """Hashes of all runs of GRAM letters that start at a letter of a token, linear in the text.

    A run that starts in a token ends in one of the next ones, so each token is looked at with its
    followers only and no position is sought from the start of the text.
    """

    def of(tokens: Column) -> Column:
        def at(i: Column) -> Column:
            def runs(piece: Column) -> Column:
                starts = F.sequence(F.lit(1), F.length(F.element_at(tokens, i)))
                return F.transform(starts, lambda j: F.xxhash64(F.substr(piece, j, F.lit(GRAM))))

            return let(F.array_join(F.slice(tokens, i, F.lit(GRAM)), " "), runs)

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(tokens)), at)))

    return let(F.filter(F.split(folded, " "), lambda token: token != ""), lambda t: F.when(F.size(t) > 0, of(t)))


def names_in_text(
    texts: DataFrame, key: str, text: str, hits: DataFrame, names: DataFrame, scope: Sequence[str],
    spread: Callable[[DataFrame], DataFrame] = as_they_lie,
) -> DataFrame:
    """(text_key, title_key, name, n, first) for each name of a hit title that is part of the text.

    A name is anchored by its first letters: of a text's letter grams only the hashes that may be such an
    anchor are exploded and shuffled, and the text itself joins once, to verify the few names whose anchor
    it has. The texts that have a hit are a table in the shared folder, so the others are read once more and
    not shuffled. ``spread`` deals them out for the grams.
    """
    own = [*scope, "text_key"]
    keyed = texts.select(*scope, F.col(key).alias("text_key"), F.col(text).alias("_text"))
    wanted = stored(rows_of(keyed, own, hits.select(*own).distinct()).select(*own, fold_tokens("_text").alias("folded")))
    anchored = names.filter(F.length("name") >= GRAM).withColumn("gram", F.xxhash64(F.substring("name", 1, GRAM)))
    may_be = bit_filter(anchored.select("gram"), "gram")
    grams = spread(wanted).select(*own, F.explode(F.filter(letter_grams("folded"), may_be)).alias("gram"))
    likely = grams.join(hits, own).join(anchored, [*scope, "title_key", "gram"]).drop("gram")
    return likely.join(wanted, own).filter(F.contains("folded", F.col("name"))).drop("folded")


def catalogue_match(
    candidates: DataFrame, key: str, text: str, profiles: DataFrame, scope: Sequence[str] = (),
    prefixes: Sequence[str] = vocab.TITLE_PREFIXES, generic: Sequence[str] = vocab.GENERIC_TITLE_WORDS,
    spread: Callable[[DataFrame], DataFrame] = as_they_lie,
) -> DataFrame:
    """One outcome per candidate: resolved, ambiguous or unresolved, each with its reason.

    ``profiles`` has profile_id, title, profile_title, level and the scope columns. Titles are
    matched once each, however many profiles share them. A profile name counts when it is long
    enough and part of the text; its first letters are equi-joined with the letter grams of the
    text, so the profiles of one title are never paired with all texts that name the title. The
    title hits are checkpointed as narrow pairs and the profiles as their counted names, which every later
    step reads. ``spread`` deals out the candidates where their texts are read, and only there.
    """
    names = cut_lineage(profile_names(profiles, scope))
    titles = names.groupBy(*scope, "title_key").agg(F.sum("n").alias("n_profiles"))
    hits = hit_pairs(spread(candidates), key, text, titles, scope, prefixes, generic)
    present = names_in_text(candidates, key, text, hits, names, scope, spread).groupBy(*scope, "text_key").agg(
        F.sum("n").alias("profile_hits"), F.min("first").alias("_only")
    )
    named = hits.join(titles, [*scope, "title_key"]).groupBy(*scope, "text_key").agg(
        F.sum("n_profiles").alias("title_hits")
    )
    counted = named.join(present, [*scope, "text_key"], "left").withColumnRenamed("text_key", key)
    joined = candidates.join(counted, [*scope, key], "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("title_hits", "profile_hits")}
    )
    resolved = F.col("profile_hits") == 1
    return joined.withColumns(
        {
            "match_status": F.when(resolved, "resolved")
            .when((F.col("profile_hits") > 1) | ((F.col("profile_hits") == 0) & (F.col("title_hits") > 1)), "ambiguous")
            .otherwise("unresolved"),
            "match_reason": F.when(F.col("title_hits") == 0, "no_rsosh_title")
            .when(resolved, "title_and_profile")
            .when(F.col("profile_hits") > 1, "multiple_profiles_in_candidate")
            .when(F.col("title_hits") == 1, "title_without_profile")
            .otherwise("title_has_multiple_profiles"),
            "matched_profile_id": F.when(resolved, F.col("_only.profile_id")),
            "matched_level": F.when(resolved, F.col("_only.level")),
        }
    ).drop("_only")


def alternatives(
    ambiguous: DataFrame, key: str, text: str, profiles: DataFrame, scope: Sequence[str] = (),
    prefixes: Sequence[str] = vocab.TITLE_PREFIXES, generic: Sequence[str] = vocab.GENERIC_TITLE_WORDS,
    spread: Callable[[DataFrame], DataFrame] = as_they_lie,
) -> tuple[DataFrame, DataFrame]:
    """What a reviewer has to choose from for ambiguous candidates, as (choices, classes).

    Choices (key, title_key, name): the profiles of that title with that name, where names of the
    title's profiles are in the text; else all profiles of the title, and name is NULL. Classes
    (title_key, name, profile_id) hold each profile once. A title with very many profiles so costs its
    profiles once and each text that names it one row, not their product.
    """
    names = cut_lineage(profile_names(profiles, scope))
    titles = names.select(*scope, "title_key").distinct()
    hits = hit_pairs(spread(ambiguous), key, text, titles, scope, prefixes, generic)
    present = names_in_text(ambiguous, key, text, hits, names, scope, spread).select(*scope, "text_key", "title_key", "name")
    silent = hits.join(present.select(*scope, "text_key").distinct(), [*scope, "text_key"], "left_anti")
    choices = present.unionByName(silent.withColumn("name", F.lit(None).cast("string"))).withColumnRenamed("text_key", key)
    classes = profiles.select(*scope, fold_tokens("title").alias("title_key"), fold_tokens("profile_title").alias("name"), "profile_id")
    return cut_lineage(choices.distinct()), classes


def expanded(choices: DataFrame, classes: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Choices with each of their profiles: as many rows as all of them have together."""
    named = choices.filter("name IS NOT NULL").join(classes, [*scope, "title_key", "name"])
    whole = choices.filter("name IS NULL").drop("name").join(classes, [*scope, "title_key"])
    return named.unionByName(whole)


#: Programmes of a scope that bear a folded name or code, that are the code-only scope of it, and that have it as name.
HITS = ("_name_hits", "_code_hits", "_title_hits")


def programme_hits(programmes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Programmes counted per scope and folded name or code, in one grouping.

    A full code folds to a text of its own, so the code-only scopes of a code are among the programmes of
    its folded form.
    """
    full = (F.col("catalogue_status") == "code_only") & direction_code("external_code").eqNullSafe(F.col("external_code"))
    folded = programmes.select(
        *scope, "programme_id", fold_tokens("name").alias("_title"), fold_tokens("external_code").alias("_folded"),
        F.coalesce(full, F.lit(False)).alias("_full"),
    )
    names = F.array_distinct(F.array_compact(F.array("_title", "_folded")))
    is_code = F.col("_full") & F.col("_name").eqNullSafe(F.col("_folded"))
    return (
        folded.select(*scope, "programme_id", "_title", "_folded", "_full", F.explode(names).alias("_name"))
        .groupBy(*scope, "_name")
        .agg(
            F.count(F.lit(1)).alias("_name_hits"), F.min("programme_id").alias("_name_id"),
            F.count_if(is_code).alias("_code_hits"), F.min(F.when(is_code, F.col("programme_id"))).alias("_code_id"),
            F.count_if(F.col("_name").eqNullSafe(F.col("_title"))).alias("_title_hits"),
        )
    )


def unique_programme(
    candidates: DataFrame, selector: str, programmes: DataFrame, scope: Sequence[str], output: str = "programme_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Resolve a selector to exactly one programme of its scope, else NULL.

    A full code goes to the single code-only scope of that code; several of those stop the search.
    Otherwise the one programme whose folded name or code equals the selector. Programmes are
    counted per key before the one join, so no candidate row is multiplied.

    ``programmes`` has programme_id, external_code, name, catalogue_status and the scope columns.
    ``keep`` names those of ``HITS`` that the result is to have, 0 where there is none.
    """
    keyed = candidates.withColumn("_is_code", direction_code(selector).isNotNull()).withColumn("_name", fold_tokens(selector))
    joined = keyed.join(programme_hits(programmes, scope), [*scope, "_name"], "left").na.fill(0, list(HITS))
    coded = F.col("_is_code") & (F.col("_code_hits") > 0)
    found = F.when(coded, F.when(F.col("_code_hits") == 1, F.col("_code_id"))).when(F.col("_name_hits") == 1, F.col("_name_id"))
    return joined.withColumn(output, found).select(*[c for c in candidates.columns if c != output], *keep, output)


def named_scope(candidate_adapter: Column, payload_kind: Column, programme: Column) -> Column:
    """Programme name that may become a scope of its own: one adapter, one row kind, no collective word."""
    name = strip(F.coalesce(programme, F.lit("")))
    allowed = (
        (candidate_adapter == vocab.NAMED_SCOPE_ADAPTER)
        & (payload_kind == vocab.PROGRAMME_FIRST_KIND)
        & (name != "")
        & direction_code(name).isNull()
        & ~let(fold_tokens(name), lambda folded: contains_any(folded, vocab.BLOCKED_SCOPE_PARTS))
    )
    return F.when(allowed, name)


def missing_scopes(
    candidates: DataFrame, selector: str, named: str, programmes: DataFrame, scope: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Scope rows to create for unresolved selectors, the first spelling in queue order naming each.

    ``named`` is the column with the permitted programme name (see ``named_scope``) or NULL.
    """
    code = direction_code(selector)
    codes = candidates.withColumn("external_code", code).filter(F.col("external_code").isNotNull())
    known_codes = programmes.filter(F.col("catalogue_status") == "code_only").select(*scope, "external_code")
    names = candidates.filter(code.isNull() & F.col(named).isNotNull()).withColumn("_name", fold_tokens(named))
    known_names = programmes.select(*scope, fold_tokens("name").alias("_name"))
    return _scopes(
        codes.join(known_codes, [*scope, "external_code"], "left_anti"), names.join(known_names, [*scope, "_name"], "left_anti"),
        named, scope, order,
    )


def unknown_scopes(candidates: DataFrame, selector: str, named: str, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``missing_scopes`` of candidates that have the ``HITS`` of their selector already, so the programmes are not read again.

    ``named`` is the selector itself where it is permitted, so it folds to the same name.
    """
    code = direction_code(selector)
    codes = candidates.withColumn("external_code", code).filter(F.col("external_code").isNotNull() & (F.col("_code_hits") == 0))
    names = candidates.filter(code.isNull() & F.col(named).isNotNull() & (F.col("_title_hits") == 0))
    return _scopes(codes, names.withColumn("_name", fold_tokens(named)), named, scope, order)


def _scopes(codes: DataFrame, names: DataFrame, named: str, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    new_codes = keep_first(codes, [*scope, "external_code"], order).select(
        *scope,
        "external_code",
        F.concat(F.lit(vocab.CODE_SCOPE_LABEL), F.col("external_code")).alias("name"),
        F.lit("code_only").alias("catalogue_status"),
        level_of_code("external_code").alias("degree_level"),
    )
    new_names = keep_first(names, [*scope, "_name"], order).select(
        *scope,
        F.lit(None).cast("string").alias("external_code"),
        F.col(named).alias("name"),
        F.lit("named_verified").alias("catalogue_status"),
        F.lit("bachelor").alias("degree_level"),
    )
    return new_codes.unionByName(new_names)


def gate_reason(
    adapter: Column, payload_kind: Column, confidence: Column, location: Column, identity: Sequence[Column],
    diploma: Column, benefit: Column,
) -> Column:
    """First reason that keeps a candidate from automatic publication, NULL when complete."""
    generic = (
        (F.coalesce(adapter, F.lit("")) != "")
        & ~adapter.isin(*vocab.STRICT_CODES)
        & ~F.coalesce(payload_kind == "automatic_explicit_table_row", F.lit(False))
    )
    blank = F.lit(False)
    for part in identity:
        blank = blank | (F.coalesce(part, F.lit("")) == "")
    return F.coalesce(
        F.when(generic, "generic_source_without_explicit_table_proof"),
        F.when(~confidence.eqNullSafe(F.lit(100)), "strict_confidence_required"),
        F.when(F.coalesce(location, F.lit(0)) == 0, "missing_location_scope"),
        F.when(blank, "missing_explicit_identity"),
        F.when(~F.coalesce(diploma.isin(*vocab.AUTOMATIC_DIPLOMAS), F.lit(False)), "missing_explicit_diploma_status"),
        F.when(~F.coalesce(benefit.isin(*vocab.AUTOMATIC_BENEFITS), F.lit(False)), "missing_explicit_benefit_kind"),
    )
