"""Spelling variants: a symmetric-delete join of the corpus's words, forms by count, roots by pointer jumping.

Words are counted over all texts. Every word emits the hash of itself and of its distinct single
deletions (with the range of places that give the deletion, one run of equal letters); equal hashes
meet in one equi-join. Two words of a shared deletion differ in one letter exactly if their ranges
meet, and a word that is another's deletion is one letter shorter, so that a hot deletion yields only
true links, not the pairs of its group; the texts confirm each as one letter's difference at that place. The hash
of a deletion is made of prefix sums, so that a word of n letters costs n steps and n small rows,
never n texts. A word's form is its near word of largest count if that is `ratio` times its own;
counts grow along forms, so that chains end, and roots are found by doubling pointers in joins.

Defined results: null and empty texts have no words; a null document id counts as the empty one; rows
that repeat a document are counted again; ties go to the smaller word in code-point order; a word of
any length is taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A run of letters of Latin-1; only A-Z are folded.
LETTERS = "a-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Any odd number: it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, change=lambda doc, word: word) -> DataFrame:
    """word and n for words of at least `shortest` letters that occur at least `least` times; `change` is applied to each occurrence."""
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    words = found.select(change(F.col("doc"), F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word, itself (low -1) and its distinct deletions: the word's place, key, first and last place deleted."""
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - first[word]
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max(initial=1)), BASE, np.uint64)]), dtype=np.uint64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix64(letters + np.uint64(1)) * power[place], dtype=np.uint64)])
    start, end = upto[first], upto[first + size]
    # What stands behind a deleted letter moves one place down.
    at = np.arange(len(letters))
    left = (upto[at] - start[word]) + np.uint64(INVERSE) * (end[word] - upto[at + 1])
    opens = (place == 0) | (letters != np.concatenate([letters[:1], letters[:-1]]))
    begins = np.flatnonzero(opens)
    last = place[np.concatenate([begins[1:], [len(letters)]]) - 1] if len(begins) else begins
    key = np.concatenate([end - start, left[begins]])
    none = np.full(len(words), -1, np.int64)
    return np.concatenate([np.arange(len(words)), word[begins]]), common.mix64(key), np.concatenate([none, place[begins]]), np.concatenate([none, last])


def deletions(words: DataFrame) -> DataFrame:
    """key, id, low, high for words of id and word."""

    def run(batches):
        for batch in batches:
            for part in common.small_batches([batch], 5000):
                at, key, low, high = _keys(part.column(1).to_pylist())
                ids = part.column(0).to_numpy()[at]
                for a in range(0, len(at), 100_000):
                    cut = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(ids[cut]), pa.array(low[cut].astype(np.int32)), pa.array(high[cut].astype(np.int32))], ["key", "id", "low", "high"])

    return common.map_arrow(words.select("id", "word"), run, "key long, id long, low int, high int")


def links(words: DataFrame) -> DataFrame:
    """Each pair of near words once: left and right as structs of id, word and n."""
    keys = deletions(words)
    a, b = keys.alias("a"), keys.alias("b")
    own_a, own_b = F.col("a.low") < 0, F.col("b.low") < 0
    meet = (F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high"))
    shared = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & F.when(own_a | own_b, own_a != own_b).otherwise(meet)
    # Both sides are one shuffle, which Spark makes once.
    pairs = a.hint("merge").join(b, shared).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.greatest("a.low", "b.low").alias("at"))
    whole = F.struct("id", "word", "n")
    left, right = words.select(F.col("id").alias("i"), whole.alias("left")), words.select(F.col("id").alias("j"), whole.alias("right"))
    met = pairs.join(left, "i").join(right, "j")
    # The exact distance, in time that grows with the length: what is left without the letter at the place.
    cut = lambda w: F.concat(F.substring(w, F.lit(1), F.col("at")), F.substring(w, F.col("at") + 2, F.length(w)))
    a, b = F.col("left.word"), F.col("right.word")
    more = F.length(a) - F.length(b)
    one = F.when(more == 0, (a != b) & (cut(a) == cut(b))).when(more == 1, cut(a) == b).when(more == -1, a == cut(b)).otherwise(False)
    return met.where(one).select("left", "right")


def variants(counted: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words of word and n."""
    space = common.Space(counted.sparkSession)
    words = space.keep(counted.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = links(words)
    both = pairs.select(F.col("left.id").alias("id"), F.col("right").alias("other")).unionAll(pairs.select(F.col("right.id"), "left"))
    best = F.min(F.struct((-F.col("other.n")).alias("less"), F.col("other.word").alias("word"), F.col("other.id").alias("id")))
    near = both.groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    large = -F.col("best.less") >= ratio * F.col("n")
    told = words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.word")).alias("form"),
        F.when(large, -F.col("best.less")).cast("long").alias("form_n"), F.when(large, F.col("best.id")).alias("to"))
    told = space.keep(told, "forms")
    space.drop(words)
    to = space.keep(told.where("to is not null").select("id", "to"), "pointers")
    # Each round doubles the length of the chains that the pointers pass over.
    while True:
        next_ = to.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        moved = space.keep(to.join(next_, "to", "left").select("id", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "pointers")
        space.drop(to)
        to = moved
        if to.where("moved").isEmpty():
            break
    root = told.select(F.col("id").alias("to"), F.col("word").alias("root"))
    roots = to.select("id", "to").join(root, "to").select("id", "root")
    out = told.drop("to").join(roots, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(doc: Column, run: Column, every: int = 199) -> Column:
    """The run, of one in `every` of a document's runs without one letter; the checksum of id and run decides."""
    h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(count_words(common.spread(common.table(spark, sf_dir, "documents")), change=misspelt))


_BYTES = "flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
_STEP = "CASE WHEN {0} % 2 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
OP11_SQL = f"""
WITH RECURSIVE steps(b, c, i) AS (SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT b, {_STEP.format("c")}, i + 1 FROM steps WHERE i < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE i = 8),
runs AS MATERIALIZED (SELECT doc, run, count(*) AS k FROM (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({_BYTES}, lambda x: x::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM runs, tab),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -n, other := other)) AS m FROM near GROUP BY word),
told AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 5 * w.n THEN m.other END AS form, CASE WHEN -m.less >= 5 * w.n THEN -m.less END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, "end", step) AS (SELECT word, word, 0 FROM told UNION ALL SELECT c.word, t.form, step + 1 FROM chain c JOIN told t ON t.word = c."end" WHERE t.form IS NOT NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM told JOIN (SELECT word, arg_max("end", step) AS root FROM chain GROUP BY word) USING (word)
"""
