"""Line deduplication: lines that are alike up to a Jaccard similarity of their character shingles.

Only DataFrame functions are used. Lines are normalised (lower case, single spaces, no spaces at the ends) and
equal ones become one vertex, named by the hash of the line. Its shingles are rows only within a task: the lines are
shuffled once by their name, and each signature is an aggregation over rows that are already together. A
signature has the minima of the shingle hashes under ``BANDS * ROWS`` orders: as many hashes as a band has rows, each
with its order changed by XOR with constants. Sixteen bits of each minimum are kept.

Lines that agree in all rows of a band share a bucket. In each bucket every line is compared with the line that has
the most copies and with the last by name, exactly, unless fewer than 15 of their 30 minima agree (of lines of
similarity 0.8, one pair in twenty thousand; short lines are always compared), and connected components join what is similar.

In buckets that still hold several components, all pairs of lines from different components whose signatures agree
enough are compared, if the smaller shingle set has the share of the larger one that the similarity asks for. Small
sets travel with their lines and are compared on the spot, so that only similar pairs leave that place. Of larger sets, up to
``ROUGH`` shingles, sixteen bits of each hash travel, which tell most pairs that are not similar, and the rest are
compared by their texts. A set is built once for each line, and a pair is compared in the first band that it shares. A bucket with more than ``CHUNK`` lines is dealt out as pairs of chunks, and a component that fills a
chunk has chunks of its own, which are not paired with each other. So no line has a limit of partners, and no
task holds more than two chunks of a bucket. One line per component stays: the first by document id and line number.

Two lines of similarity 0.8 share a bucket and agree in 15 minima with probability 0.9992 (at 0.85, 0.9999); pairs that do
not are only found together if other lines connect them.

Edge cases: blank lines are never removed. A line shorter than a shingle is one shingle. Null texts have no lines
and stay null. Equal rows are one document; rows that share an id but not their text are several, as are those with a
null id, which come last. A document all of whose lines stand elsewhere stays with an empty text. An empty table gives an empty result. Lines are read
whole; the pieces that long ones are cut into overlap, so no shingle is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescore.llm.common import delete, folder, free_name, store, without_places
from tidescore.llm.components import components
from tidescore.operators.skew import broadcast_if_small

SHINGLE, SIMILARITY = 8, 0.8
BANDS, ROWS = 10, 3
# Minima that have to agree before lines are compared, and shingles below which they need not.
LEAST_AGREEING, SHORT = 15, 32
# Shingles of the largest set that travels with its line: those that a short line can be similar to, and more.
CARRIED = 128
# Shingles of the largest set that travels as sixteen bits of each hash, to tell what cannot be similar.
ROUGH = 4096
# Lines of a bucket that are compared with each other in one place.
CHUNK = 256
# Shingles that one generated array holds.
PIECE = 4096
LAST = 2**63 - 1


def normal(line: Column) -> Column:
    """Lower case and single spaces. Most lines have single spaces already and need no pattern."""
    low, coded = F.trim(F.lower(line)), line.cast("binary")  # bytes are searched faster than characters
    spaced = F.contains(coded, F.lit(b"  "))
    for space in (b"\t", b"\x0b", b"\x0c", b"\r"):
        spaced = spaced | F.contains(coded, F.lit(space))
    return F.when(spaced, F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "))).otherwise(low)


def _constant(number: int) -> int:
    """A fixed pattern of 64 bits, as a signed number."""
    value = (number + 1) * 0x9E3779B97F4A7C15 % 2**64
    value = (value ^ value >> 31) * 0xBF58476D1CE4E5B9 % 2**64
    return (value ^ value >> 29) - 2**63


def _place(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What names a document: its id, or the greatest bigint for a null id, and the hash of its text."""
    return F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST)), F.xxhash64(F.col(f"`{text_col}`"))


def all_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, whole, line, name, text`` of each line that is not blank."""
    doc, whole = _place(id_col, text_col)
    rows = docs.select(doc.alias("doc"), whole.alias("whole"),
                       F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("line", "raw"))
    rows = rows.select("doc", "whole", "line", normal(F.col("raw")).alias("text")).filter("text <> ''")
    return rows.select("doc", "whole", "line", F.xxhash64("text").alias("name"), "text")


def _shingle(code_points: Column, byte: Column) -> Column:
    """The shingle that begins at a byte (from 1), from a line in four bytes per character."""
    return F.substring(code_points, byte, F.lit(4 * SHINGLE))


def signatures(lines: DataFrame) -> DataFrame:
    """From ``name, text`` to ``name, n, last, minima`` of each distinct line: ``n`` copies, ``last`` + 1 shingles."""
    whole = lines.groupBy("name").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))
    last = F.greatest(F.char_length("text") - SHINGLE, F.lit(0))
    coded = whole.select("name", "n", F.encode("text", "UTF-32").alias("coded"), last.alias("last"))
    starts = coded.select("name", "n", "coded", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(PIECE))).alias("start"))
    end = F.least(F.col("start") + (PIECE - 1), F.col("last"))
    places = starts.select("name", "n", "coded", F.explode(F.sequence("start", end)).alias("at"))
    cut = places.select("name", "n", "at", _shingle(F.col("coded"), F.col("at") * 4 + 1).alias("shingle"))
    hashed = cut.select("name", "n", "at", *[F.xxhash64(F.lit(row), "shingle").alias(f"h{row}") for row in range(ROWS)])
    minima = [F.min(F.col(f"h{k % ROWS}").bitwiseXOR(F.lit(_constant(k)))).alias(f"m{k}") for k in range(BANDS * ROWS)]
    signed = hashed.groupBy("name").agg(F.max("n").alias("n"), F.max("at").alias("last"), *minima)
    low = [F.shiftright(F.shiftleft(f"m{k}", 48), 48).cast("smallint") for k in range(BANDS * ROWS)]
    return signed.select("name", "n", "last", F.array(*low).alias("minima"))


def _bands(minima: Column) -> Column:
    """The buckets of a signature: which band, and the bits of its minima."""
    def bits(k):
        return minima[k].cast("bigint").bitwiseAND(F.lit(0xFFFF))

    found = []
    for band in range(BANDS):
        key = F.lit(band).cast("bigint")
        for row in range(ROWS):
            key = F.shiftleft(key, 16).bitwiseOR(bits(band * ROWS + row))
        found.append(key)
    return F.array(*found)


def _comparable(one: str, other: str) -> Column:
    """Whether two signatures agree enough, or a line is too short to say."""
    equal = F.zip_with(f"minima_{one}", f"minima_{other}", lambda a, b: (a == b).cast("int"))
    agreeing = F.aggregate(equal, F.lit(0), lambda total, same: total + same)
    return (F.least(f"last_{one}", f"last_{other}") < SHORT) | (agreeing >= LEAST_AGREEING)


def _packed(minima: Column) -> list[Column]:
    """The minima, a band of them to a number."""
    bands = _bands(minima)
    return [bands[band].alias(f"packed{band}") for band in range(BANDS)]


def _packed_comparable(one: str, other: str) -> Column:
    """``_comparable`` of packed minima. A sum sets the highest bit of each sixteen that hold a difference."""
    different = F.lit(0)
    for band in range(BANDS):
        bits = F.col(f"packed{band}_{one}").bitwiseXOR(F.col(f"packed{band}_{other}"))
        above = bits.bitwiseAND(F.lit(0x7FFF7FFF7FFF)) + F.lit(0x7FFF7FFF7FFF)
        different = different + F.bit_count(above.bitwiseOR(bits).bitwiseAND(F.lit(0x800080008000)))
    return (F.least(f"last_{one}", f"last_{other}") < SHORT) | (different <= BANDS * ROWS - LEAST_AGREEING)


def _dealt(named: DataFrame) -> DataFrame:
    """From ``band, component`` and more to ``key, side`` in their place: the lines to compare share a key.

    Pairs are to be looked for among rows of side 0, and between rows of the sides 1 and 2.
    """
    sizes = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("n") >= CHUNK, F.struct(F.col("component").alias("alone"), "n"))
    crowded = sizes.groupBy("band").agg(
        F.sum("n").alias("total"), F.collect_list(own).alias("large"),
        F.coalesce(F.sum(F.when(F.col("n") < CHUNK, F.col("n"))), F.lit(0)).alias("rest")).filter(F.col("total") > CHUNK)

    def chunks(alone, n):
        last = F.ceil(n / CHUNK) - 1
        return F.transform(F.sequence(F.lit(0).cast("bigint"), last),
                           lambda part: F.struct(alone.isNotNull().alias("large"), F.coalesce(alone, F.lit(0)).alias("alone"),
                                                 part.alias("part")))

    nobody = F.lit(None).cast("bigint")
    mixed = F.when(F.col("rest") > 0, chunks(nobody, F.col("rest")))
    whole = F.flatten(F.concat(F.transform("large", lambda one: chunks(one["alone"], one["n"])),
                               F.array_compact(F.array(mixed))))
    known = named.join(broadcast_if_small(crowded.select("band", "large", "rest", whole.alias("chunks"))), "band", "left")
    found = F.filter("large", lambda one: one["alone"] == F.col("component"))
    is_large = F.coalesce(F.size(found) > 0, F.lit(False))
    parts = F.ceil(F.when(is_large, F.get(found, F.lit(0))["n"]).otherwise(F.col("rest")) / CHUNK)
    mine = F.struct(is_large.alias("large"), F.when(is_large, F.col("component")).otherwise(0).alias("alone"),
                    F.pmod(F.xxhash64("name"), parts).alias("part"))
    others = F.filter("chunks", lambda chunk: ~chunk["large"] | (chunk["alone"] != F.col("mine.alone")) | ~F.col("mine.large"))
    rows = known.withColumn("mine", F.when(F.col("chunks").isNotNull(), mine))
    rows = rows.withColumn("other", F.explode(F.coalesce(others, F.array(F.col("mine")))))
    key = F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine").isNull() | (F.col("mine") == F.col("other")), 0).when(F.col("mine") < F.col("other"), 1)
    return rows.select(key.alias("key"), side.otherwise(2).alias("side"),
                       *[name for name in named.columns if name != "band"])


def _every_shingle(text: Column) -> Column:
    """The shingle hashes of a line, with repeats. The line is encoded once, as the variable of the outer function."""
    last = F.greatest(F.char_length(text) - SHINGLE, F.lit(0))
    coded = F.array(F.encode(text, "UTF-32"))
    return F.transform(coded, lambda line: F.transform(F.sequence(F.lit(1), last * 4 + 1, F.lit(4)),
                                                       lambda byte: F.xxhash64(_shingle(line, byte))))[0]


def _shingles(text: Column) -> Column:
    """The distinct shingle hashes of a line."""
    return F.array_distinct(_every_shingle(text))


def _rough(shingles: Column) -> Column:
    """Sixteen bits of each hash of a set that is too large to travel whole, the different ones."""
    low = F.transform(shingles, lambda value: F.shiftright(F.shiftleft(value, 48), 48).cast("smallint"))
    return F.when(F.size(shingles).between(CARRIED + 1, ROUGH), F.array_distinct(low))


def _may_be_alike(one: str, other: str, similarity: float) -> Column:
    """Whether two lines can be similar by their rough sets. No similar pair fails: of the hashes that two sets share, no
    more fall together than fall together in either set."""
    lost = F.least(*[F.col(f"n_{end}") - F.size(f"rough_{end}") for end in (one, other)])
    known = F.col(f"rough_{one}").isNotNull() & F.col(f"rough_{other}").isNotNull()
    # ``_alike`` with room for rounding. The intersection is the variable of a function, which also keeps it out of the join's
    # generated code: that would get too long for the JVM to compile.
    shared = F.array(F.array_intersect(f"rough_{one}", f"rough_{other}"))
    return ~known | F.exists(shared, lambda found: (F.size(found) + lost) * (1 + similarity)
                             >= similarity * (F.col(f"n_{one}") + F.col(f"n_{other}")) - 1e-6)


def _meet_first(one: str, other: str) -> Column:
    """Whether no band before the one of these rows brings the two lines together. Where an earlier one does, they are of one
    component, or are compared there, or one of them is an end of its bucket and was compared with the other."""
    first = F.lit(True)
    for band in range(BANDS - 1):
        first = first & ((F.col(f"place_{one}") <= band) | (F.col(f"packed{band}_{one}") != F.col(f"packed{band}_{other}")))
    return first


def _alike(common: Column, n_a: Column, n_b: Column, similarity: float) -> Column:
    return common >= similarity * (n_a + n_b - common)


def similar(pairs: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of names whose lines' shingle sets have at least that Jaccard similarity."""
    both = (pairs.join(signed.toDF("a", "last_a", "minima_a"), "a").join(signed.toDF("b", "last_b", "minima_b"), "b"))
    alike = both.filter(_comparable("a", "b")).select("a", "b")
    there = alike.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    found = there.select("a", "b", _every_shingle(F.col("text_a")).alias("s_a"), _every_shingle(F.col("text_b")).alias("s_b"))
    sizes = found.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("common"), F.size(F.array_union("s_a", "s_b")).alias("all"))
    return sizes.filter(F.col("common") >= similarity * F.col("all")).select("a", "b")


def line_components(lines: DataFrame, similarity: float = SIMILARITY, once: str | None = None) -> DataFrame:
    """``id, component`` of the names of all lines that are similar to another line.

    ``once`` is the path of the lines if they are stored for this alone: it is deleted as soon as they have been read.
    """
    spark, base = lines.sparkSession, folder(lines.sparkSession, "lines")
    every = store(signatures(lines), f"{base}/every")
    members = every.select("name", "n", F.explode(_bands(F.col("minima"))).alias("band"))
    buckets = members.groupBy("band").agg(F.max_by("name", "n").alias("first"), F.max("name").alias("last"),
                                          F.min("name").alias("least")).filter("least < last").drop("least")
    buckets = store(buckets, f"{base}/buckets")
    inside = store(members.drop("n").join(broadcast_if_small(buckets), "band"), f"{base}/inside")
    names = store(inside.select("name").distinct(), f"{base}/names")
    wanted = broadcast_if_small(names)
    signed = store(every.drop("n").join(wanted, "name", "left_semi"), f"{base}/signed")
    texts = store(lines.select("name", "text").join(wanted, "name", "left_semi")
                  .groupBy("name").agg(F.min("text").alias("text")), f"{base}/texts")
    delete(spark, f"{base}/every")
    if once:
        delete(spark, once)

    stars = inside.select("name", F.explode(F.array("first", "last")).alias("end")).filter("name <> end")
    pairs = stars.select(F.least("name", "end").alias("a"), F.greatest("name", "end").alias("b")).distinct()
    edges = store(similar(pairs, signed, texts, similarity), f"{base}/edges")
    found = components(edges)

    between = inside.filter("name <> first AND name <> last").select("band", "name")
    named = store(between.join(found, F.col("name") == F.col("id"), "left")
                  .select("band", "name", F.coalesce("component", "name").alias("component")), f"{base}/named")
    several = (named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
               .filter("low < high").select("band"))
    held = (named.join(several, "band", "left_semi").groupBy("name", "component")
            .agg(F.collect_list("band").alias("bands")).join(signed, "name").join(texts, "name"))
    sets = held.select("name", "component", "bands", "last", "minima", _shingles(F.col("text")).alias("all"))
    again = store(sets.select("name", "component", "bands", "last", F.size("all").alias("n"), F.when(F.size("all") <= CARRIED,
                              F.col("all")).alias("set"), _rough(F.col("all")).alias("rough"), *_packed(F.col("minima"))),
                  f"{base}/again")
    dealt = _dealt(again.withColumn("band", F.explode("bands")).drop("bands")
                   .withColumn("place", F.shiftrightunsigned("band", 48).cast("int")))
    one, other = (dealt.filter(f"side <> {3 - number}").select("key", *[F.col(name).alias(f"{name}_{end}") for name in
                                                                       dealt.columns if name != "key"])
                  for number, end in ((1, "a"), (2, "b")))
    inside = (F.col("side_a") != 0) & (F.col("side_b") != 0) | (F.col("side_a") == F.col("side_b")) & (
        F.col("name_a") < F.col("name_b"))
    sized = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    carried = F.col("set_a").isNotNull() & F.col("set_b").isNotNull()
    exact = ~carried | _alike(common, F.col("n_a"), F.col("n_b"), similarity)
    crossed = one.join(other, (one.key == other.key) & inside & (F.col("component_a") != F.col("component_b"))
                       & sized & _meet_first("a", "b") & _packed_comparable("a", "b") & exact
                       & _may_be_alike("a", "b", similarity))
    crossed = store(crossed.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"),
                                   carried.alias("verified")).distinct(), f"{base}/crossed")
    unknown = similar(crossed.filter("NOT verified").select("a", "b"), signed, texts, similarity)
    more = store(crossed.filter("verified").select("a", "b").unionAll(unknown), f"{base}/more")
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))
    delete(spark, base)
    return found


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
                  ) -> DataFrame:
    """``doc, whole, removed``: the numbers (from 0, ascending) of the lines that go, for documents that lose some.

    ``doc`` is the document's id, or the greatest bigint for rows with a null id, and ``whole`` the hash of its text.
    """
    spark, lines = docs.sparkSession, all_lines(docs, id_col, text_col)
    once = folder(spark, "lines_once")
    lines = store(lines, once)  # the documents are split and normalised once
    places = store(lines.select("doc", "whole", "line", "name"), folder(spark, "line_places"))
    found = line_components(lines, similarity, once)
    names = places.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "line", "whole")).alias("first"))
    classed = store(names.join(found, F.col("name") == F.col("id"), "left")
                    .select("name", "n", "first", F.coalesce("component", "name").alias("component")),
                    folder(spark, "line_classes"))
    kept = (classed.groupBy("component").agg(F.sum("n").alias("n"), F.min("first").alias("kept"))
            .filter("n > 1").select("component", "kept"))
    several = store(classed.join(kept, "component").select("name", "kept"), folder(spark, "line_kept"))
    gone = places.join(several, "name").filter("doc <> kept.doc OR line <> kept.line OR whole <> kept.whole")
    return gone.groupBy("doc", "whole").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
                      ) -> DataFrame:
    """``docs`` with the text that is left; all rows and columns stay."""
    names = [free_name(docs, name) for name in ("doc__", "whole__", "removed__")]
    gone = removed_lines(docs, id_col, text_col, similarity).toDF(*names)
    text, removed = F.col(f"`{text_col}`"), F.col(names[2])
    doc, whole = _place(id_col, text_col)
    joined = docs.join(gone, (doc == F.col(names[0])) & (whole == F.col(names[1])), "left")
    left = without_places(F.split(text, "\n"), removed)
    cleaned = F.when(removed.isNull(), text).otherwise(F.array_join(left, "\n"))
    return joined.withColumn(text_col, cleaned).select(*[f"`{column}`" for column in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """A row per document: its id, its lines, how many of them go, and which (their numbers from 0)."""
    doc, whole = _place("doc_id", "text")
    rows = docs.select("doc_id", doc.alias("doc"), whole.alias("whole"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    report = rows.join(removed_lines(docs), ["doc", "whole"], "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return report.select("doc_id", "n_lines", F.size(gone).alias("n_removed"), gone.alias("removed"))
