"""Entity resolution: keep-first, score merge, batch membership, skip log, file matching."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import matching_key, slug_name, title_name, words
from rostrum.sources.io import settled


def _id(cid) -> Column:
    """An id as text; an empty one is none."""
    return F.nullif((F.col(cid) if isinstance(cid, str) else cid).cast("string"), F.lit(""))


def _name(name) -> Column:
    """A name in title form; an empty one is none."""
    return F.nullif(title_name(name), F.lit(""))


def entity_key(cid: str = "candidate_id", name: str = "name") -> Column:
    """What a record is known by: its id, else its name; null where it has neither and so is like no other."""
    return F.coalesce(F.concat(F.lit("id:"), _id(cid)), F.concat(F.lit("name:"), _name(name)))


def keep_first(rows: DataFrame, order: str, cid: str = "candidate_id", name: str = "name") -> DataFrame:
    """The first row of each id; a row without an id only where no earlier kept row has its name.

    Rows with neither id nor name (null, empty or blank) are all kept. A row with an id counts as earlier than one without at the same
    place of the order. Both windows keep one row a key, which Spark does before the shuffle too; nameless rows meet no window."""
    i, n = free_names(rows, "_id", "_name")
    r = rows.withColumns({i: _id(cid), n: _name(name)})
    first = lambda part, key: part.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    with_id = first(r.where(F.col(i).isNotNull()), i)
    named = first(r.where(F.col(i).isNull() & F.col(n).isNotNull()), n)
    taken = with_id.where(F.col(n).isNotNull()).groupBy(F.col(n).alias("_taken")).agg(F.min(order).alias("_since"))
    fresh = named.join(taken, (F.col(n) == F.col("_taken")) & (F.col("_since") <= F.col(order)), "left_anti")
    neither = r.where(F.col(i).isNull() & F.col(n).isNull())
    return with_id.unionByName(fresh).unionByName(neither).select(*rows.columns)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores in front where ``df`` has such columns."""
    have, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in have:
            w = "_" + w
        have.add(w.lower())
        out.append(w)
    return out


def positions(rows: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """``rows`` with their place (from 0) among those alike in ``keys``, by ``order``.

    Rows are dealt to ranges of the order and checkpointed; each is numbered within key and range, and the key's counts in earlier ranges, one
    row a key and range, are added. So a key that most rows share is numbered by many tasks; rows alike in all that the order names
    are dealt by where they stand."""
    part, own, before = free_names(rows, "_part", "_own", "_before")
    alike = [F.col(k) for k in keys]
    dealt = settled(rows.withColumn(own, F.monotonically_increasing_id()).repartitionByRange(*order, own).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*alike, part).orderBy(*order, own))
    numbered = dealt.withColumn(own, within).join(sizes, [*keys, part])
    return numbered.withColumn(out, F.col(own) + F.col(before) - 1).select(*rows.columns, out)


#: Parts that rows of one name are dealt to when they meet the name's counts.
SALTS = 16


def merge_scores(left: DataFrame, right: DataFrame, cid: str = "candidate_id", name: str = "name", order: str | None = None) -> DataFrame:
    """Full outer merge of two score tables; each row meets one row of the other side at most, so none is lost or doubled.

    Rows with one id meet first, the i-th with the i-th where an id stands more than once. What is left meets by name where
    one of both has no id: those with an id on the left take those without on the right; those without on the left
    take what is left on the right, those without an id first. Like-named rows are taken by id, then by ``order``, a column of both
    sides (by default a hash of all they hold). Rows with neither id nor name stay alone. Columns of both sides are the left's, else the right's."""

    def side(df: DataFrame, p: str) -> DataFrame:
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.select(whole.alias(p), _id(cid).alias(f"{p}_id"), _name(name).alias(f"{p}_name"), (F.col(order) if order else F.xxhash64(F.to_json(whole))).alias(f"{p}_by"))

    def met(l: DataFrame, r: DataFrame, key: str, also: Column | None = None) -> DataFrame:
        on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("l_at") == F.col("r_at"))
        return l.join(r, on if also is None else on & also, "full_outer").drop("l_at", "r_at")

    # Each side is read for its ids, its names and its order, and is made once for all.
    sides = {p: settled(side(df, p)) for p, df in (("l", left), ("r", right))}
    given = {p: positions(df.where(F.col(f"{p}_id").isNotNull()), [f"{p}_id"], [F.col(f"{p}_by")], f"{p}_at") for p, df in sides.items()}
    by_id = settled(met(given["l"], given["r"], "id"))
    done = by_id.where("l is not null and r is not null").select("l", "r")
    rest = {p: by_id.where(f"{q} is null").select(*df.columns).unionByName(df.where(F.col(f"{p}_id").isNull())) for (p, df), q in zip(sides.items(), "rl")}
    named = {p: df.where(F.col(f"{p}_name").isNotNull()) for p, df in rest.items()}
    # On the left those with an id come first, on the right those without: the i-th of both meet.
    l = positions(named["l"], ["l_name"], [F.col("l_id").isNull(), F.col("l_id"), F.col("l_by")], "l_at")
    r = positions(named["r"], ["r_name"], [F.col("r_id").isNotNull(), F.col("r_id"), F.col("r_by")], "r_at")
    # Rows with an id on the right come after the left's with an id, which they cannot meet.
    heads = l.where("l_id is not null").select(F.col("l_name").alias("_n"), F.lit(1).alias("_more"))
    heads = heads.unionAll(r.where("r_id is null").select("r_name", F.lit(-1))).groupBy("_n").agg(F.greatest(F.sum("_more"), F.lit(0)).alias("_more"))
    heads = heads.where("_more > 0").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = r.join(heads, (F.col("r_name") == F.col("_n")) & (F.pmod("r_at", F.lit(SALTS)) == F.col("_s")) & F.col("r_id").isNotNull(), "left")
    r = later.withColumn("r_at", F.col("r_at") + F.coalesce("_more", F.lit(0))).select(*r.columns)
    by_name = met(l, r, "name", F.col("l_id").isNull() | F.col("r_id").isNull()).select("l", "r")
    none = lambda p: F.lit(None).cast(sides[p].schema[p].dataType).alias(p)
    alone = rest["l"].where("l_name is null").select("l", none("r")).unionByName(rest["r"].where("r_name is null").select(none("l"), "r"))
    both = [c for c in left.columns if c in right.columns]
    cell = lambda p, c: F.col(p)[c]
    out = [F.coalesce(cell("l", c), cell("r", c)).alias(c) for c in both] + [cell("l", c).alias(c) for c in left.columns if c not in both] + [cell("r", c).alias(c) for c in right.columns if c not in both]
    return done.unionByName(by_name).unionByName(alone).select(*out)


def in_batch(scores: DataFrame, batch: DataFrame, cid: str = "candidate_id", name: str = "name") -> DataFrame:
    """Rows whose id or normalised name is in the batch."""
    ids = batch.where(F.col(cid).isNotNull()).select(F.col(cid).alias("_i")).distinct().withColumn("_by_id", F.lit(True))
    names = batch.select(title_name(name).alias("_nm")).where("_nm <> ''").distinct().withColumn("_by_name", F.lit(True))
    marked = scores.join(ids, F.col(cid) == F.col("_i"), "left").join(names, title_name(name) == F.col("_nm"), "left")
    return marked.where("_by_id or _by_name").select(*scores.columns)


def lookup(rows: DataFrame, records: DataFrame, cid: str = "candidate_id") -> DataFrame:
    return rows.join(records, cid, "left")


def append_skips(log: DataFrame, new: DataFrame, cid: str = "candidate_id") -> DataFrame:
    """The log and the new rows whose id it does not have; rows without an id always."""
    fresh = new.join(log.where(F.col(cid).isNotNull()).select(cid).distinct(), cid, "left_anti")
    return log.unionByName(fresh.select(*new.columns), allowMissingColumns=True)


#: Letters of a gram, by which contained texts are looked up; shorter texts are grams themselves. Long enough that a number of several
#: digits has a gram of its own: the fewer texts a rarest gram has, the less is compared.
GRAM = 8


def _grams(text: Column, sizes=range(1, GRAM + 1)) -> Column:
    """The distinct substrings of so many letters."""
    n = F.length(text)
    cut = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[cut(k) for k in sizes]))) if sizes else F.array().cast("array<string>")


def _sizes(parts: DataFrame) -> list[int]:
    """The sizes of grams that texts (part) are looked up by, ``GRAM`` numbers at most."""
    return sorted(r[0] for r in parts.where("part <> ''").select(F.least(F.length("part"), F.lit(GRAM))).distinct().collect())


def _merged(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """An inner join that sorts both sides. Spark takes exploded texts for as small as the files they came from, and would send them through the driver."""
    return left.join(right.hint("merge"), on)


def _rarest(parts: DataFrame, grams: DataFrame) -> DataFrame:
    """(part, g, n): of each distinct text (part) the gram that fewest of the texts behind ``grams`` (g) have, and how many have it.

    A part with a gram that none has is in none of them and is left out."""
    frequent = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.length("part"), F.lit(GRAM))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("part") - size + 1), lambda i: F.substr(F.col("part"), i, size)))
    asked = parts.where("part <> ''").distinct().withColumn("own", own).select("part", F.size("own").alias("all"), F.explode("own").alias("g"))
    found = _merged(asked, frequent, "g").groupBy("part").agg(F.min(F.struct("n", "g")).alias("m"), F.count(F.lit(1)).alias("have"), F.first("all").alias("all"))
    return found.where("have = all").select("part", "m.g", "m.n")


def containing(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(part, text) of the distinct texts of two tables where the text contains the part, neither empty.

    A part is looked up under its rarest gram alone, so what is compared beyond the pairs found does not grow with what the
    texts have in common."""
    t = texts.where("text <> ''").distinct()
    grams = t.select("text", F.explode(_grams(F.col("text"), _sizes(parts))).alias("g"))
    return _merged(_rarest(parts, grams), grams, "g").where(F.contains("text", "part")).select("part", "text")


def match_files(people: DataFrame, files: DataFrame) -> DataFrame:
    """(candidate_id, path, kind) of people (candidate_id, name, stem of the record) and files (path, stem): the best file by

    1. name words of over two letters that the file's stem contains, two of them, or the only one there is;
    2. the record's stem;
    3. either stem containing the other; ties by path.

    Contained texts meet by an equi join on their rarest gram and are checked after. As two words of a name must be found, its most
    frequent word need not be looked up, so that a common first name makes no pairs of its own. Names, stems and files alike are
    compared once; only a stem's first file by path is carried. People, files and what each way finds are checkpointed, so that
    neither table is made again for each way, and no join of theirs goes through the driver."""
    p = settled(people.select("candidate_id", "stem", matching_key("stem").alias("rs"), F.array_distinct(F.filter(words(matching_key("name")), lambda w: F.length(w) > 2)).alias("w")))
    f = settled(files.where("path is not null").select("path", "stem", matching_key("stem").alias("fs")))
    first = f.where("fs <> ''").groupBy("fs").agg(F.min("path").alias("path"))
    names = p.select("w").where(F.size("w") > 0).distinct().withColumn("need", F.least(F.lit(2), F.size("w")))
    asked = names.select("w", "need", F.explode("w").alias("part"))
    grams = first.select("fs", F.explode(_grams(F.col("fs"), _sizes(asked))).alias("g"))
    asked = _merged(asked, _rarest(asked.select("part"), grams), "part").withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("n", "part")))
    # Words that no file has are gone, so at most need - 1 of those left may be passed over.
    left = F.count(F.lit(1)).over(Window.partitionBy("w"))
    asked = asked.withColumn("left", left).where("r <= left - need + 1").select("w", "need", "part", "g")
    named = _merged(asked, grams, "g").where(F.contains("fs", "part")).where(F.size(F.filter("w", lambda w: F.contains("fs", w))) >= F.col("need"))
    named = _merged(named.select("w", "fs"), first, "fs").groupBy("w").agg(F.min("path").alias("path"))
    exact = f.groupBy("stem").agg(F.min("path").alias("path"))
    stems, others = p.select("rs").distinct(), first.select("fs")
    inner = containing(stems.select(F.col("rs").alias("part")), others.select(F.col("fs").alias("text"))).select(F.col("part").alias("rs"), F.col("text").alias("fs"))
    outer = containing(others.select(F.col("fs").alias("part")), stems.select(F.col("rs").alias("text"))).select(F.col("text").alias("rs"), F.col("part").alias("fs"))
    either = _merged(settled(inner).unionAll(settled(outer)), first, "fs").groupBy("rs").agg(F.min("path").alias("path"))
    every = None
    for kind, (key, found) in enumerate((("w", settled(named)), ("stem", exact), ("rs", either)), 1):
        found = _merged(p.select("candidate_id", key), found, key).select("candidate_id", "path", F.lit(kind).alias("kind"))
        every = found if every is None else every.unionAll(found)
    return every.groupBy("candidate_id").agg(F.min(F.struct("kind", "path")).alias("m")).select("candidate_id", "m.path", "m.kind")


def find_paths(people: DataFrame, mapping: DataFrame, files: DataFrame) -> DataFrame:
    """(candidate_id, name, path, kind) of each distinct person (candidate_id, name): the file that the mapping (key, path) gives for

    1. the id, 2. the name's slug, 3. a key with the name's slug, the first by key (the name in any spelling is such a key); else
    4. the first file by path whose stem has that slug. Only paths among ``files`` (path) count; path and kind are null where none is left.
    An empty slug finds nothing. Each table of keys has one row a key, so the joins never multiply people."""
    there = files.where("path is not null").select("path").distinct()
    known = mapping.where("key is not null and key <> ''").join(there, "path", "left_semi")
    by_key = known.groupBy("key").agg(F.min("path").alias("path"))
    by_slug = known.groupBy(slug_name("key").alias("key")).agg(F.min(F.struct(F.col("key").alias("first"), "path")).path.alias("path"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    by_stem = there.groupBy(slug_name(stem).alias("key")).agg(F.min("path").alias("path"))
    out = people.select("candidate_id", "name").distinct().withColumn("_slug", slug_name("name"))
    for i, (keys, on) in enumerate(((by_key, "candidate_id"), (by_key, "_slug"), (by_slug, "_slug"), (by_stem, "_slug")), 1):
        side = keys.where("key <> ''").select(F.col("key").alias(f"_k{i}"), F.col("path").alias(f"_p{i}"))
        out = out.join(side, F.col(on) == F.col(f"_k{i}"), "left")
    ways = range(1, 5)
    kind = F.coalesce(*[F.when(F.col(f"_p{i}").isNotNull(), i) for i in ways])
    return out.select("candidate_id", "name", F.coalesce(*[F.col(f"_p{i}") for i in ways]).alias("path"), kind.alias("kind"))


def assign_leftovers(people: DataFrame, files: DataFrame, arbitrary: bool = False) -> DataFrame:
    """(candidate_id, path, kind) of people (candidate_id, name) and files (path) that nothing else has brought together: 1, the first file by
    path whose stem has the name's slug, each file given once, to the first such person by id. With ``arbitrary``, 2: the i-th person left takes the i-th file left."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    by_slug = files.where("path is not null").select("path", slug_name(stem).alias("slug")).where("slug <> ''").groupBy("slug").agg(F.min("path").alias("path"))
    first = people.select("candidate_id", slug_name("name").alias("slug")).where("slug <> ''").groupBy("slug").agg(F.min("candidate_id").alias("candidate_id"))
    exact = settled(first.join(by_slug, "slug").select("candidate_id", "path", F.lit(1).alias("kind")))
    if not arbitrary:
        return exact
    p = people.select("candidate_id").distinct().join(exact, "candidate_id", "left_anti").withColumn("all", F.lit(0))
    f = files.where("path is not null").select("path").distinct().join(exact, "path", "left_anti").withColumn("all", F.lit(0))
    p, f = positions(p, ["all"], [F.col("candidate_id")], "at"), positions(f, ["all"], [F.col("path")], "at")
    return exact.unionByName(p.join(f.drop("all"), "at").select("candidate_id", "path", F.lit(2).alias("kind")))


def duplicate_counts(rows: DataFrame, cid: str = "candidate_id") -> DataFrame:
    """One row: rows, distinct ids, surplus rows, rows without an id."""
    per = rows.groupBy(cid).agg(F.count(F.lit(1)).alias("n"))
    given = F.col(cid).isNotNull()
    return per.agg(F.sum("n").alias("n_rows"), F.count_if(given).alias("n_ids"), F.coalesce(F.sum(F.when(given, F.col("n") - 1)), F.lit(0)).alias("n_surplus"), F.coalesce(F.sum(F.when(~given, F.col("n"))), F.lit(0)).alias("n_without_id"))
