r"""Spelling variants: words of the corpus that differ by one edit, and the form that each of them is a variant of.

Pairs come from a composition of finite-state machines: the minimised acceptor of a set of words, a transducer that makes one
edit, and the acceptor again. A composed state is (state, edits so far, state), and the accepted paths are the pairs.

The vocabulary is not one machine: a pair whose shorter word has L code points and whose first difference is at i of the window
lo <= i < hi shares its first lo and its last L - hi code points. These are the initial state of a partition: the words that share
them are one acceptor, which has only what stands between. Two windows, each a half of 0..L, see every pair
once. A partition with over LARGE words, or a window of over WIDE places, is cut into two with half the window; a window of one place
leaves so few symbols between that the alphabet bounds it. So no partition grows with the corpus and no word is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KNOWN, read_table, written

LETTERS = r"[A-Za-zÀ-ÿ]+"
DROP = 97
LEAST_LENGTH = 5
LEAST_TIMES = 3
#: A form is so many times as frequent as its variant, or more.
TIMES = 2
LARGE = 8192
WIDE = 1024
_PARTITION = ("short", "lo", "hi", "head", "tail")


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words; state 0 is the initial one."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final = [False]
        register: dict[tuple, int] = {}
        path, before = [0], ""
        for word in [*words, ""]:
            keep = 0
            while keep < min(len(word), len(before)) and word[keep] == before[keep]:
                keep += 1
            for depth in range(len(before), keep, -1):  # what no later word passes through is complete: merged with an equal state
                state = path.pop()
                self.edges[path[-1]][before[depth - 1]] = register.setdefault((self.final[state], tuple(self.edges[state].items())), state)
            for c in word[keep:]:
                self.edges[path[-1]][c] = len(self.edges)
                path.append(len(self.edges))
                self.edges.append({})
                self.final.append(False)
            if word or (words and not words[0] and not before):
                self.final[path[-1]] = True
            before = word


def near_pairs(words: list[str]) -> Iterator[tuple[str, str, int]]:
    """(x, y, place of the first difference): pairs of sorted distinct words that one edit turns into each other, each once; y is the longer or the greater one."""
    machine = Acceptor(words)
    edges, final = machine.edges, machine.final
    known: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        """What both states accept: the paths from the composed state (p, 1, q)."""
        todo = [(p, q) if p < q else (q, p)]
        top = todo[0]
        while todo:
            a, b = pair = todo[-1]
            if pair in known:
                todo.pop()
                continue
            steps = [(c, (s, t) if s < t else (t, s)) for c, s in edges[a].items() if (t := edges[b].get(c)) is not None]
            if missing := [x for _, x in steps if x not in known]:
                todo += missing
                continue
            known[pair] = [""] * (final[a] and final[b]) + [c + rest for c, x in steps for rest in known[x]]
            todo.pop()
        return known[top]

    paths = [(0, "")]
    while paths:  # composed states (p, 0, p)
        p, head = paths.pop()
        out = sorted(edges[p].items())
        for k, (c, s) in enumerate(out):
            paths.append((s, head + c))
            for d, t in out[k + 1 :]:
                for rest in common(s, t):
                    yield head + c + rest, head + d + rest, len(head)
            for rest in common(p, s):
                if rest[:1] != c:  # else the first difference is further on
                    yield head + rest, head + c + rest, len(head)


def vocabulary(docs: DataFrame, drop: int = DROP, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of letters, of which one in `drop` loses a code point that its document and itself choose."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    runs = runs.select("doc", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", ascii_uppercase, ascii_lowercase)).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = F.expr("cast(crc32(concat(doc, ':', run)) % char_length(run) as int)")
    word = F.when(h % drop == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def _windows(words: DataFrame, *bounds: tuple[Column, Column]) -> DataFrame:
    """words (word, n, short) once for each window (lo, hi), with the partition that they are in there and what stands between."""
    tail = F.greatest(F.lit(0), F.col("short") - F.col("hi"))
    size = F.char_length("word")
    made = words.withColumn("window", F.explode(F.array(*[F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for lo, hi in bounds])))
    made = made.select("word", "n", "short", "window.lo", "window.hi")
    return made.select("word", "n", "short", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")).alias("head"), F.substring("word", size - tail + 1, tail).alias("tail"), F.substring("word", F.col("lo") + 1, size - F.col("lo") - tail).alias("core"))


def partitions(words: DataFrame, large: int = LARGE, wide: int = WIDE) -> DataFrame:
    """words (word, n) in all partitions where they may meet a near word; none of them has over `large` words and more than one place to differ in."""
    size = F.char_length("word")
    both = words.withColumn("short", F.explode(F.array(size, size - 1)))
    half = F.floor(F.col("short") / 2)
    rows, done = _windows(both, (F.lit(0), half), (half, F.col("short") + 1)), []
    while True:
        rows = written(rows, "partitions")
        met = rows.groupBy(*_PARTITION).agg(F.count("*").alias("many")).where(((F.col("many") > large) | ((F.col("hi") - F.col("lo") > wide) & (F.col("many") > 1))) & (F.col("hi") - F.col("lo") > 1)).drop("many")
        met = written(met, "large")
        many = met.limit(KNOWN + 1).count()
        if not many:
            done.append(rows)
            break
        met = F.broadcast(met) if many <= KNOWN else met
        done.append(rows.join(met, list(_PARTITION), "left_anti").select(*rows.columns))
        cut = rows.join(met, list(_PARTITION), "left_semi").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2))
        left = _windows(cut.select("word", "n", "short", "lo", "mid"), (F.col("lo"), F.col("mid")))
        right = _windows(cut.select("word", "n", "short", "hi", "mid"), (F.col("mid"), F.col("hi")))
        rows = left.unionByName(right)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_words(words: DataFrame, large: int = LARGE, wide: int = WIDE) -> DataFrame:
    """(word, n, near, near_n) of words (word, n): every pair of near words, both ways round."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key: tuple, members: list[tuple[str, str, int]]) -> Iterator[tuple]:
            short, lo, hi = key[:3]
            own = {core: (word, n) for core, word, n in members}
            for x, y, at in near_pairs([core for core, *_ in members]):
                a, b = own[x], own[y]
                if lo + at < hi and len(a[0]) == short:
                    yield *a, *b
                    yield *b, *a

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64()) * 2)], ["word", "n", "near", "near_n"])

        key, members, out = None, [], []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*_PARTITION, "core", "word", "n")]
            for *now, core, word, n in zip(*columns):
                if now != key:
                    out += pairs(key, members) if len(members) > 1 else ()
                    key, members = now, []
                    if len(out) > 10_000:
                        yield table(out)
                        out = []
                members.append((core, word, n))
        out += pairs(key, members) if len(members) > 1 else ()
        if out:
            yield table(out)

    dealt = partitions(words, large, wide).repartition(*_PARTITION).sortWithinPartitions(*_PARTITION, "core")
    return dealt.mapInArrow(work, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form that can be reached; a chain's way halves with every round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, drop: int = DROP, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, times: int = TIMES, large: int = LARGE, wide: int = WIDE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs (doc_id, text).

    A null text has no words; a null doc_id is written as nothing; repeated rows count as often as they stand there; words without a
    near word, or without one frequent enough, have no form and are their own root. Ties of frequency go to the least word in
    code-point order. No rows give no rows; other columns play no part.
    """
    words = written(vocabulary(docs, drop, least_length, least_times), "words")
    best = near_words(words, large, wide).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("fits", -F.col("best.less") >= times * F.col("n"))
    found = written(found.select("word", F.when(F.col("fits"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n")), "forms")
    last = roots(found.where("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with their forms and roots."""
    return variants(read_table(spark, sf_dir, "documents"))


#: The same rows: crc32 by a table of 256 that its rule makes, pairs by joins of words without one code point.
SQL = f"""
with recursive crc as (
  select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: case when c % 2 = 1 then xor(c >> 1, {0xEDB88320}) else c >> 1 end)) as tab
), runs as (
  select doc_id, translate(run, '{ascii_uppercase}', '{ascii_lowercase}') as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by all
), keyed as (
  select run, times, encode(doc_id || ':' || run) as key from runs
), hashed as (
  select run, times, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(key)), lambda i: ('0x' || substr(hex(key), 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) as h from keyed, crc
), words as (
  select word, sum(times)::bigint as n from (
    select case when h % {DROP} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed)
  where length(word) >= {LEAST_LENGTH} group by word having sum(times) >= {LEAST_TIMES}
), cut as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word)))::int as i from words)
), near as (
  select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, c.n, w.word, w.n from cut c join words w on c.rest = w.word
  union select w.word, w.n, c.word, c.n from cut c join words w on c.rest = w.word
), ranked as (
  select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, encode(near)) as turn from near
), forms as (
  select w.word, case when r.near_n >= {TIMES} * w.n then r.near end as form, w.n, coalesce(r.n_near, 0)::bigint as n_near, case when r.near_n >= {TIMES} * w.n then r.near_n end as form_n
  from words w left join ranked r on r.word = w.word and r.turn = 1
), chain as (
  select word, word as at from words
  union all select c.word, f.form from chain c join forms f on f.word = c.at where f.form is not null
)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n
from forms f join (select c.word, c.at from chain c join forms l on l.word = c.at where l.form is null) c on c.word = f.word
"""
