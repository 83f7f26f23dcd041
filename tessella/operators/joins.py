"""Joins: lookups, phrase matches, anti joins, alignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.regex import let, words_ws
from tessella.operators.phrases import find

SEP = "\x01"


def lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left outer lookup into a table with one row a key; a repeated key on the right fails when the plan runs."""
    once = right.withColumn("_n", F.count("*").over(W.partitionBy(right_key)))
    checked = once.withColumn(right_key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key is not unique: "), F.col(right_key).cast("string")))).otherwise(F.col(right_key))).drop("_n")
    return left.join(checked, left[left_key] == checked[right_key], "left")


def aligned(docs: DataFrame, marks: DataFrame, doc_key: str, mark_key: str, tokens: Column, position: str, spelling: str) -> DataFrame:
    """Documents none of whose marks (position from 1, expected token) disagree; a position that is no number, or out of range, disagrees."""
    words = docs.select(F.col(doc_key).alias("_k"), tokens.alias("_t"))
    place = F.coalesce(F.expr(f"try_cast(`{position}` AS int)"), F.lit(-1))
    pairs = marks.select(F.col(mark_key).alias("_m"), place.alias("_p"), F.col(spelling).alias("_s")).join(words, F.col("_m") == F.col("_k"))
    bad = pairs.filter((F.col("_p") < 1) | ~F.coalesce(F.get("_t", F.col("_p") - 1) == F.col("_s"), F.lit(False))).select("_k").distinct()
    return docs.join(bad, docs[doc_key] == bad["_k"], "left_anti")


def marks_with_verdict(docs: DataFrame, marks: DataFrame, doc_key: str, mark_key: str, tokens: Column, position: str, spelling: str, value: str) -> DataFrame:
    """Each mark with Yes or No, its value blanked on No; T1 order columns are kept."""
    words = docs.select(F.col(doc_key).alias("_k"), tokens.alias("_t"))
    place = F.coalesce(F.expr(f"try_cast(`{position}` AS int)"), F.lit(-1))
    good = (place >= 1) & F.coalesce(F.get("_t", place - 1) == F.col(spelling), F.lit(False))
    out = marks.join(words, marks[mark_key] == words["_k"]).withColumn("match", F.when(good, "Yes").otherwise("No"))
    return out.withColumn(value, F.when(F.col("match") == "Yes", F.col(value)).otherwise("")).drop("_k", "_t")


def any_mismatch(verdicts: DataFrame, key: str, flag: str = "match") -> DataFrame:
    """How many keys have any No."""
    return verdicts.groupBy(key).agg(F.bool_or(F.col(flag) == "No").alias("bad")).agg(F.count_if("bad").alias("n_keys"))


def _by_key(key: Column, longest: int) -> Column:
    """The tokens of a phrase given as one string; none for phrases of more than longest tokens."""
    parts = F.split(key, SEP)
    return F.when(F.size(parts) <= longest, parts).otherwise(F.array().cast("array<string>"))


def phrase_matches(docs: DataFrame, phrases: DataFrame, key: str, tokens: Column, phrase_id: str, phrase_tokens: Column) -> DataFrame:
    """(key, pos, phrase_id): where each phrase stands."""
    return find(docs, key, tokens, phrases, phrase_tokens, [phrase_id]).select(key, "pos", phrase_id)


def phrase_contains(docs: DataFrame, phrases: DataFrame, key: str, tokens: Column, phrase_id: str, phrase_tokens: Column) -> DataFrame:
    """(key, phrase_id), each once, if the phrase stands anywhere."""
    return phrase_matches(docs, phrases, key, tokens, phrase_id, phrase_tokens).select(key, phrase_id).distinct()


def lookup_list(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, order: str, sep: str = "; ", name: str = "values") -> DataFrame:
    """All values of a key in order, joined; blanks for keys without any."""
    lists = right.groupBy(right_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), sep).alias(name)).withColumnRenamed(right_key, "_rk")
    return left.join(lists, left[left_key] == lists["_rk"], "left").withColumn(name, F.coalesce(name, F.lit(""))).drop("_rk")


def ngram_join(docs: DataFrame, phrases: DataFrame, key: str, tokens: Column, phrase_id: str, phrase_key: Column, longest: int = 4, most: int = 12) -> DataFrame:
    """The phrases that stand in a row, longest first, most of them at most."""
    found = find(docs, key, tokens, phrases, _by_key(phrase_key, longest), [phrase_id])
    once = found.groupBy(key, phrase_id).agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "pos", phrase_id))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most)


def token_candidates(tokens: DataFrame, lexicon: DataFrame, on: str, by: list[str], order: list[str], k: int = 3) -> DataFrame:
    """The first k lexicon rows of each token place, in an order of lexicon columns; a token's rows are cut to k before they meet its places."""
    first = lexicon.withColumn("_r", F.row_number().over(W.partitionBy(on).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
    return tokens.join(first, on).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def greedy_spans(found: Column, most: int = 8) -> Column:
    """Of struct(pos, n, key, hint), longest match from left to right without overlap; a (key, hint) seen
    before is skipped without taking its place, so shorter matches inside it may still count."""
    kind = "array<struct<pos:int,n:int,key:string,hint:string>>"
    ordered = F.array_sort(F.transform(found, lambda f: F.struct(f["pos"].alias("pos"), (-f["n"]).alias("n"), f["key"].alias("key"), f["hint"].alias("hint"))))

    def take(acc: Column, f: Column) -> Column:
        seen = F.exists(acc["out"], lambda o: (o["key"] == f["key"]) & (o["hint"] == f["hint"]))
        free = (f["pos"] >= acc["next"]) & ~seen & (F.size(acc["out"]) < most)
        new = F.array(F.struct(f["pos"].alias("pos"), (-f["n"]).alias("n"), f["key"].alias("key"), f["hint"].alias("hint")))
        return F.struct(F.when(free, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"), F.when(free, f["pos"] - f["n"]).otherwise(acc["next"]).alias("next"))

    return F.aggregate(ordered, F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("next")), take)["out"]


def hints(docs: DataFrame, lexicon: DataFrame, key: str, tokens: Column, form_key: str, hint: str, longest: int = 4, most: int = 8) -> DataFrame:
    """J10 as a join: the lexicon's forms are found in the texts, then each row folds its own matches. One column, hints, is added."""
    forms = lexicon.select(F.col(form_key).alias("_f"), F.col(hint).alias("_h"))
    found = find(docs, key, tokens, forms, _by_key(F.col("_f"), longest), ["_f", "_h"]).withColumnRenamed(key, "_k")
    per = found.groupBy("_k").agg(F.collect_list(F.struct("pos", "n", F.col("_f").alias("key"), F.col("_h").alias("hint"))).alias("_m")).select("_k", greedy_spans(F.col("_m"), most).alias("hints"))
    none = F.array().cast("array<struct<pos:int,n:int,key:string,hint:string>>")
    return docs.join(per, docs[key] == per["_k"], "left").withColumn("hints", F.coalesce("hints", none)).drop("_k")


_ALIASED = "struct<next:int,used:array<int>,taken:array<struct<pos:int,n:int,source:string,target:string,name:string>>>"


def _aliases(found: Column, pools: dict[str, list[tuple[str, str]]], most: int) -> Column:
    """Of matches struct(pos, n, name, kind): those replaced, with their aliases. From left to right, the longest first; each takes
    the next alias of its kind; where a kind has none left the match is passed over as a whole."""
    kinds = sorted(pools)
    ordered = F.array_sort(F.transform(found, lambda f: F.struct(f["pos"].alias("pos"), (-f["n"]).alias("n"), f["name"].alias("name"), f["kind"].alias("kind"))))
    pool = F.create_map(*(x for k in kinds for x in (F.lit(k), F.array(*(F.struct(F.lit(u).alias("source"), F.lit(v).alias("target")) for u, v in pools[k])) if pools[k] else F.array().cast("array<struct<source:string,target:string>>"))))

    def step(acc: Column, f: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, kinds)), f["kind"]).cast("int") - 1
        alias = F.get(F.try_element_at(pool, f["kind"]), F.get(acc["used"], place))
        free = (f["pos"] >= acc["next"]) & (F.size(acc["taken"]) < most)
        real = free & F.coalesce((alias["source"] != "") & (alias["target"] != ""), F.lit(False))
        new = F.struct(f["pos"].alias("pos"), (-f["n"]).alias("n"), alias["source"].alias("source"), alias["target"].alias("target"), f["name"].alias("name"))
        used = F.transform(acc["used"], lambda u, i: F.when((i == place) & real, u + 1).otherwise(u))
        return F.struct(F.when(free, f["pos"] - f["n"]).otherwise(acc["next"]).alias("next"), used.alias("used"), F.when(real, F.concat(acc["taken"], F.array(new))).otherwise(acc["taken"]).alias("taken")).cast(_ALIASED)

    start = F.struct(F.lit(0).alias("next"), F.array(*(F.lit(0) for _ in kinds)).alias("used"), F.array().alias("taken")).cast(_ALIASED)
    return F.aggregate(ordered, start, step)["taken"]


def alias_names(df: DataFrame, key: str, text: str, lexicon: DataFrame, form: str, name: str, kind: str, pools: dict[str, list[tuple[str, str]]], longest: int = 4, most: int = 8) -> DataFrame:
    """Names of the lexicon (form: its tokens joined by SEP) replaced by aliases of their kind, most of them at most; two columns
    are added: aliased, and pairs (alias in the target, name) to restore. pools: (source alias, target alias) in order, by kind."""
    tokens = words_ws(F.coalesce(F.col(text), F.lit("")))
    forms = lexicon.select(F.col(form).alias("_f"), F.col(name).alias("_name"), F.col(kind).alias("_kind"))
    found = find(df, key, tokens, forms, _by_key(F.col("_f"), longest), ["_name", "_kind"]).withColumnRenamed(key, "_k")
    per = found.groupBy("_k").agg(F.collect_list(F.struct("pos", "n", F.col("_name").alias("name"), F.col("_kind").alias("kind"))).alias("_m")).select("_k", _aliases(F.col("_m"), pools, most).alias("_taken"))

    def rewritten(t: Column) -> Column:
        parts = F.aggregate(
            "_taken",
            F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")),
            lambda acc, x: F.struct(F.concat(acc["out"], F.slice(t, acc["at"] + 1, x["pos"] - acc["at"]), F.split(x["source"], " ")).alias("out"), (x["pos"] + x["n"]).alias("at")),
        )
        return F.array_join(let(parts, lambda p: F.concat(p["out"], F.slice(t, p["at"] + 1, F.size(t)))), " ")

    joined = df.join(per, df[key] == per["_k"], "left")
    pairs = F.coalesce(F.transform("_taken", lambda x: F.struct(x["target"].alias("alias"), x["name"].alias("name"))), F.array().cast("array<struct<alias:string,name:string>>"))
    return joined.select(*(df[c] for c in df.columns), F.when(F.size("_taken") > 0, let(tokens, rewritten)).otherwise(F.col(text)).alias("aliased"), pairs.alias("pairs"))


def restore_names(df: DataFrame, text: str = "aliased", pairs: str = "pairs") -> DataFrame:
    """Aliases back to names, longest alias first, whole words of ASCII letters, any case."""
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct((-F.length(p["alias"])).alias("n"), p["alias"].alias("alias"), p["name"].alias("name"))))
    quoted = lambda a: F.concat(F.lit(r"(?i)(?<![A-Za-z])\Q"), a, F.lit(r"\E(?![A-Za-z])"))
    return df.withColumn("restored", F.aggregate(ordered, F.col(text), lambda acc, p: F.regexp_replace(acc, quoted(p["alias"]), F.regexp_replace(p["name"], F.lit(r"([\\$])"), F.lit(r"\\$1")))))


def drop_dominated(df: DataFrame, key: str, items: str) -> DataFrame:
    """Rows whose item set is no strict subset of another row's; equal sets all stay. Each distinct set looks for larger ones
    among those that hold its rarest item, so that common items bring no pairs together."""
    sets = df.select(F.col(key).alias("_k"), F.array_sort(F.array_distinct(items)).alias("_s"))
    kinds = sets.select("_s").distinct()
    each = kinds.select("_s", F.explode("_s").alias("_i"))
    common = each.groupBy("_i").agg(F.count("*").alias("_c"))
    rarest = each.join(common, "_i").groupBy("_s").agg(F.min_by("_i", F.struct("_c", "_i")).alias("_i"))
    below = rarest.join(each.select(F.col("_s").alias("_t"), "_i"), "_i").filter((F.size("_t") > F.size("_s")) & (F.size(F.array_except("_s", "_t")) == 0)).select("_s").distinct()
    some = kinds.filter(F.size("_s") > 0).limit(1).select(F.array().cast(kinds.schema["_s"].dataType).alias("_s"))  # the empty set is below any other
    gone = sets.join(below.unionAll(some), "_s", "left_semi").select("_k")
    return df.join(gone, df[key] == gone["_k"], "left_anti")


def double_index(tokens: DataFrame, exact: DataFrame, folded: DataFrame, by: list[str], token: str, fold: str, entry: str) -> DataFrame:
    """Per row and entry the larger of the exact and the folded count."""
    one = tokens.join(exact, token).groupBy(*by, entry).agg(F.count("*").alias("exact"))
    two = tokens.join(folded, fold).groupBy(*by, entry).agg(F.count("*").alias("folded"))
    return one.join(two, [*by, entry], "full_outer").select(*by, entry, F.greatest(F.coalesce("exact", F.lit(0)), F.coalesce("folded", F.lit(0))).alias("n"))


def unambiguous(df: DataFrame, form: str, kind: str, target: str) -> DataFrame:
    """Rows of forms whose only type is the target."""
    only = df.groupBy(form).agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).filter((F.col("lo") == F.col("hi")) & (F.col("lo") == target)).select(form)
    return df.join(only, form, "left_semi")


def precedence_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of the first, and of the second what the first has no key for."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def first_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def align_by_id(reference: DataFrame, hypothesis: DataFrame, key: str, value: str) -> DataFrame:
    """One to one by id; a missing or repeated id fails when the plan runs."""

    def once(df: DataFrame, name: str) -> DataFrame:
        g = df.groupBy(key).agg(F.first(value).alias(name), F.count("*").alias("n"))
        return g.select(F.when(F.col("n") > 1, F.raise_error(F.lit("repeated id"))).otherwise(F.col(key)).alias(key), F.coalesce(name, F.lit("")).alias(name))

    both = once(reference, "reference").join(once(hypothesis, "hypothesis"), key, "full_outer")
    gap = F.col("reference").isNull() | F.col("hypothesis").isNull()
    return both.select(F.when(gap, F.raise_error(F.lit("ids do not match"))).otherwise(F.col(key)).alias(key), "reference", "hypothesis")


def concat_pools(*pools: DataFrame) -> DataFrame:
    """Candidates of several models, each pool's rows after the one's before."""
    out = None
    for i, p in enumerate(pools):
        p = p.withColumn("pool", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def candidate_pairs(df: DataFrame, by: str, pos: str, columns: list[str]) -> DataFrame:
    """Ordered pairs of one row's candidates, which a pool caps."""
    a = df.select(by, *(F.col(c).alias(f"a_{c}") for c in [pos, *columns]))
    b = df.select(by, *(F.col(c).alias(f"b_{c}") for c in [pos, *columns]))
    return a.join(b, by).filter(F.col(f"a_{pos}") != F.col(f"b_{pos}"))


def pending(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """J22"""
    return every.join(done.select(key).distinct(), key, "left_anti")


def lexicon_index(lexicon: DataFrame, fields: list[str], normalize: Callable[[Column], Column], order: str, longest: int = 4) -> DataFrame:
    """(field, key, n, order) of each row's fields; values are normalised once each, then joined back."""
    long = lexicon.select(F.col(order).alias("ord"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("f")).select("ord", "f.*").filter("value is not null and trim(value) <> ''")
    forms = long.select("value").distinct().withColumn("tokens", F.filter(F.split(normalize(F.col("value")), " "), lambda t: t != ""))
    return long.join(forms, "value").filter((F.size("tokens") > 0) & (F.size("tokens") <= longest)).select("field", F.array_join("tokens", SEP).alias("key"), F.size("tokens").alias("n"), "ord")


def pick_replacement(df: DataFrame, options: DataFrame, group: str, option: str, own: str, seed: Column) -> DataFrame:
    """Of the group's distinct options in order, without the row's own, the one at md5(seed) modulo their number; null if there is none.

    Options are numbered once, and a row looks its choice up by group and number: no row carries all options."""
    from tessella.functions.text import md5_index

    numbered = options.select(F.col(group).alias("_g"), F.col(option).alias("_o")).distinct().withColumn("_n", F.row_number().over(W.partitionBy("_g").orderBy("_o")) - 1)
    sizes = numbered.groupBy("_g").agg(F.count("*").alias("_size"))
    mine = numbered.select(F.col("_g").alias("_mg"), F.col("_o").alias("_mo"), F.col("_n").alias("_mn"))
    rows = df.join(sizes, df[group] == F.col("_g"), "left").drop("_g").join(mine, (df[group] == F.col("_mg")) & (df[own] == F.col("_mo")), "left")
    left = F.col("_size") - F.when(F.col("_mn").isNotNull(), 1).otherwise(0)
    at = F.when(left > 0, md5_index(seed, F.greatest(left, F.lit(1))))
    rows = rows.withColumn("_at", F.when(F.col("_mn").isNotNull() & (at >= F.col("_mn")), at + 1).otherwise(at))
    chosen = numbered.select(F.col("_g").alias("_cg"), F.col("_n").alias("_cn"), F.col("_o").alias("replacement"))
    return rows.join(chosen, (df[group] == F.col("_cg")) & (F.col("_at") == F.col("_cn")), "left").select(*(df[c] for c in df.columns), "replacement")


def entity_index(lexicon: DataFrame, spellings: DataFrame | None, normalize: Callable[[Column], Column], hint: Callable[[Column], Column], order: str = "_ord", longest: int = 4) -> DataFrame:
    """(form, place, kind, hint): the distinct hints of each named entity's form, in lexicon order.

    lexicon: form, type, lexeme, norm and order; persons (PN) and places (GN) count, their hint is the lexeme, or else norm. spellings: name,
    spellings between semicolons, order; they come behind the lexicon's."""
    names = lexicon.filter(F.trim("type").isin("PN", "GN"))
    told = F.coalesce(F.nullif(hint(F.col("lexeme")), F.lit("")), F.nullif(hint(F.col("norm")), F.lit("")))
    rows = names.select(F.lit(0).alias("_from"), F.col(order).alias("_o"), F.lit(0).alias("_i"), F.col("form").alias("raw"), F.trim("type").alias("kind"), told.alias("hint"))
    if spellings is not None:
        parts = spellings.select(F.lit(1).alias("_from"), F.col(order).alias("_o"), F.posexplode(F.split(F.coalesce("spellings", F.lit("")), ";")).alias("_i", "raw"), F.lit("ONOMASTICON").alias("kind"), F.nullif(hint(F.col("name")), F.lit("")).alias("hint"))
        rows = rows.unionByName(parts)
    rows = _formed(rows.filter("hint is not null"), normalize, longest)
    # The lexicon's repeats count once, those of the spellings each.
    each = F.when(F.col("_from") == 1, F.struct("_o", "_i"))
    once = rows.groupBy("form", "kind", "hint", each.alias("_each")).agg(F.min(F.struct("_from", "_o", "_i")).alias("first"))
    return once.withColumn("place", F.row_number().over(W.partitionBy("form").orderBy("first")).cast("long")).select("form", "place", "kind", "hint")


def _formed(rows: DataFrame, normalize: Callable[[Column], Column], longest: int) -> DataFrame:
    """With form: the tokens of the normalised raw form joined by SEP, 1 to longest of them."""
    tokens = F.filter(F.split(normalize(F.coalesce("raw", F.lit(""))), r"\s+"), lambda t: t != "")
    return rows.withColumn("_t", tokens).filter((F.size("_t") > 0) & (F.size("_t") <= longest)).withColumn("form", F.array_join("_t", SEP)).drop("_t", "raw")


def proper_names(lexicon: DataFrame, spellings: DataFrame, normalize: Callable[[Column], Column], order: str = "_ord", longest: int = 4) -> DataFrame:
    """(form, name, kind) of the forms that are a person's or a place's name alone; the first row of a form wins, the lexicon's before
    the spellings'. A form that the lexicon has under several types, or another one, is left out."""
    squeezed = lambda c: F.array_join(words_ws(F.coalesce(c, F.lit(""))), " ")
    known = _formed(lexicon.select(F.lit(0).alias("_from"), F.col(order).alias("_o"), F.lit(0).alias("_i"), squeezed(F.col("form")).alias("raw"), F.trim(F.coalesce("type", F.lit(""))).alias("kind"), squeezed(F.col("lexeme")).alias("name")), normalize, longest)
    types = known.groupBy("form").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    more = spellings.select(F.lit(1).alias("_from"), F.col(order).alias("_o"), F.posexplode(F.split(F.coalesce("spellings", F.lit("")), ";")).alias("_i", "raw"), F.lit("PN").alias("kind"), squeezed(F.col("name")).alias("name"))
    rows = known.unionByName(_formed(more, normalize, longest)).filter((F.col("name") != "") & F.col("kind").isin("PN", "GN"))
    sure = rows.join(types, "form", "left").filter(F.col("lo").isNull() | ((F.col("lo") == F.col("kind")) & (F.col("hi") == F.col("kind"))))
    first = sure.groupBy("form").agg(F.min_by(F.struct("name", "kind"), F.struct("_from", "_o", "_i")).alias("x"))
    return first.select("form", "x.name", "x.kind")
