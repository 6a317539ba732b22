"""SQL over the driver tables with the rows of the queries, for those that SQL can express; written from the operators' definitions."""

from __future__ import annotations

from voxplan.plans.fixtures import FR64, FRAME, HOP, RATE, SIG, SIG16, SYM, WINDOW, WINDOW_HOP

# Fixed values of the default model (four states, left to right) and of the warm one of word w0, written out here so that the operators' own are held against them.
_PI = (0.97, 0.02, 0.005, 0.005)
_A = ((0.6, 0.4, 0.0, 0.0), (0.0, 0.6, 0.4, 0.0), (0.0, 0.0, 0.6, 0.4), (0.0, 0.0, 0.0, 1.0))
_WARM_B = (0.4, 0.3, 0.1, 0.1, 0.1)

PRE = "pre AS (SELECT word, recording, idx, CASE WHEN idx = 0 THEN 0e0 ELSE x - 0.95e0 * lag(x) OVER (PARTITION BY word, recording ORDER BY idx) END AS x FROM sig)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0e0"


def with_(*ctes: str, out: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes) + "\n" + out


def _stats(src: str, p: str, frame: int = FRAME, hop: int = HOP) -> str:
    """{p}k: frames of each recording; {p}st: power and zero crossings of each frame."""
    return f"""{p}k AS (SELECT word, recording, count(*) AS n, CAST(trunc((count(*) - {frame}) / {hop}.0e0) AS BIGINT) + 1 AS k FROM {src} GROUP BY ALL),
{p}fr AS (SELECT word, recording, i, i * {hop} AS a, CASE WHEN i < k - 1 THEN i * {hop} + {frame} ELSE n - 1 END AS e FROM (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM {p}k WHERE k > 0)),
{p}sl AS (SELECT *, abs(sign(lead(x) OVER (PARTITION BY word, recording ORDER BY idx)) - sign(x)) AS d FROM {src}),
{p}st AS (SELECT f.word, f.recording, f.i AS frame, sum(s.x * s.x) / count(*) AS power, coalesce(sum(s.d) FILTER (s.idx < f.e - 1), 0) * 0.5e0 AS zcr FROM {p}fr f JOIN {p}sl s ON s.word = f.word AND s.recording = f.recording AND s.idx >= f.a AND s.idx < f.e GROUP BY ALL)"""


def _cut(src: str, p: str, start: str, stop: str, hop: int = HOP) -> str:
    """{p}out: samples between the hops of the first frame of `start` and the last of `stop`."""
    return f"""{p}m AS (SELECT *, max(power) OVER (PARTITION BY word, recording) AS mp, max(zcr) OVER (PARTITION BY word, recording) AS mz FROM {p}st),
{p}b AS (SELECT word, recording, min(frame) FILTER ({start}) AS f, max(frame) FILTER ({stop}) AS l FROM {p}m GROUP BY ALL),
{p}c AS (SELECT word, recording, coalesce(f, 0) * {hop} AS a, (CASE WHEN f IS NULL THEN k ELSE l END) * {hop} AS e FROM {p}b JOIN {p}k USING (word, recording)),
{p}out AS (SELECT s.word, s.recording, CAST(s.idx - c.a AS BIGINT) AS idx, s.x FROM {src} s JOIN {p}c c ON s.word = c.word AND s.recording = c.recording AND s.idx >= c.a AND s.idx < c.e)"""


def _hamming(src: str, p: str, window: int = WINDOW, hop: int = WINDOW_HOP) -> str:
    """{p}out: samples times the product of the weights of all windows over them."""
    return f"""{p}hk AS (SELECT word, recording, count(*) AS n, CAST(trunc((count(*) - {window}) / {hop}.0e0) AS BIGINT) + 1 AS k FROM {src} GROUP BY ALL),
{p}w AS (SELECT word, recording, i * {hop} AS a, CASE WHEN i < k THEN i * {hop} + {window} ELSE n - 1 END AS e FROM (SELECT *, unnest(generate_series(0, k)) AS i FROM {p}hk WHERE k >= 0)),
{p}f AS (SELECT s.word, s.recording, s.idx, product(0.54e0 - 0.46e0 * cos(2 * pi() * (s.idx - w.a) / {window - 1}e0)) AS f FROM {src} s JOIN {p}w w ON s.word = w.word AND s.recording = w.recording AND s.idx >= w.a AND s.idx < w.e GROUP BY ALL),
{p}out AS (SELECT s.word, s.recording, s.idx, s.x * coalesce(f.f, 1e0) AS x FROM {src} s LEFT JOIN {p}f f ON s.word = f.word AND s.recording = f.recording AND s.idx = f.idx)"""


_LONG = f"SELECT word, recording, idx, {r6('x')} AS x FROM "
_ONE = ("power > 0.4e0 * mp", "power > 0.4e0 * mp")
_BATCH = ("power > 0.015e0 * mp", "power > 0.015e0 * mp")
_TWO = ("zcr > 0.5e0 * mz AND power > 0.5e0 * mp", "zcr > 0.4e0 * mz AND power > 0.3e0 * mp")
_LIVE = ("zcr > 0.08e0 * mz AND power > 0.15e0 * mp", "zcr > 0.03e0 * mz AND power > 0.10e0 * mp")


def _purposes(src: str) -> str:
    return f"""names AS (SELECT DISTINCT word, recording FROM {src}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY recording) AS r, count(*) OVER (PARTITION BY word) AS n FROM names),
purposes AS (SELECT word, recording, CASE WHEN r <= floor(n * 0.3e0) THEN 'train' WHEN r <= floor(n * 0.3e0) + floor(n * 0.5e0) THEN 'hmm' ELSE 'test' END AS purpose FROM ranked)"""


def _frames(src: str, frame: int, hop: int, tail: int) -> str:
    return f"""fn AS (SELECT word, recording, count(*) AS n, CASE WHEN count(*) >= {frame} THEN CAST(floor((count(*) - {frame}) / {hop}.0e0) AS BIGINT) + 1 ELSE 0 END AS k FROM {src} GROUP BY ALL),
fi AS (SELECT word, recording, n, k, unnest(generate_series(0, CASE WHEN n - k * {hop} >= {tail} THEN k ELSE k - 1 END)) AS i FROM fn WHERE k > 0 OR n >= {tail}),
frames AS (SELECT f.word, f.recording, CAST(f.i AS INT) AS frame_number, CAST(count(*) AS INT) AS n, {r6("sum(s.x)")} AS total FROM fi f JOIN {src} s ON s.word = f.word AND s.recording = f.recording AND s.idx >= f.i * {hop} AND s.idx < f.i * {hop} + {frame} GROUP BY ALL)"""


_EACH = "each AS (SELECT word, recording, frame_number, unnest(mfcc) AS v, CAST(unnest(range(13)) AS INT) AS pos FROM fr)"
_MEAN = "mean AS (SELECT pos, avg(v) AS v FROM each GROUP BY pos)"
_FOUR = "four AS (SELECT CAST(2 * a.i + b.i AS INT) AS id, pos, v * a.f * b.f AS v FROM mean, (VALUES (0, 1.001e0), (1, 0.999e0)) a(i, f), (VALUES (0, 1.001e0), (1, 0.999e0)) b(i, f))"


def _assign(book: str, p: str, columns: str = "pos > 0") -> str:
    """{p}: nearest id of each frame."""
    return f"""{p}d AS (SELECT e.word, e.recording, e.frame_number, c.id, sqrt(sum((e.v - c.v) * (e.v - c.v)) FILTER (e.{columns})) AS d FROM each e JOIN {book} c USING (pos) GROUP BY ALL),
{p} AS (SELECT word, recording, frame_number, id AS parent_centroid_id, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word, recording, frame_number ORDER BY round(d, 12), id) AS r FROM {p}d) WHERE r = 1)"""


def _update(assigned: str, p: str, k: int) -> str:
    return f"{p} AS (SELECT CAST(g.id AS INT) AS id, CAST(q.pos AS INT) AS pos, coalesce(m.v, 0e0) AS v FROM range({k}) g(id) CROSS JOIN range(13) q(pos) LEFT JOIN (SELECT parent_centroid_id AS id, pos, avg(v) AS v FROM each JOIN {assigned} USING (word, recording, frame_number) GROUP BY ALL) m ON m.id = g.id AND m.pos = q.pos)"


def _split(src: str, p: str) -> str:
    return f"{p} AS (SELECT CAST(2 * s.id + x.i AS INT) AS id, pos, v * x.f AS v FROM {src} s, (VALUES (0, 1.001e0), (1, 0.999e0)) x(i, f))"


_ASSIGNED = (FR64, _EACH, _MEAN, _FOUR, _assign("four", "near"))
_BOOK = f"SELECT id, pos, {r6('v')} AS v FROM "
_KEYS = "word, recording, frame_number"
_MAG = "mag AS (SELECT word, recording, frame_number, sqrt(sum(v * v)) AS m FROM each GROUP BY ALL)"
_FAULTY = "faulty AS (SELECT word, recording, frame_number, raw_samples, CASE frame_number WHEN 5 THEN CAST([0,0,0,0,0,0,0,0,0,0,0,0,0] AS DOUBLE[]) WHEN 3 THEN mfcc[1:12] ELSE mfcc END AS mfcc FROM fr)"

_START = f"""words AS (SELECT DISTINCT word FROM sym),
start AS (
  SELECT word, 'pi' AS kind, i, 0 AS j, p FROM words, (VALUES {", ".join(f"({i}, {p}e0)" for i, p in enumerate(_PI))}) t(i, p)
  UNION ALL SELECT word, 'a', i, j, p FROM words, (VALUES {", ".join(f"({i}, {j}, {p}e0)" for i, r in enumerate(_A) for j, p in enumerate(r))}) t(i, j, p)
  UNION ALL SELECT word, 'b', i, j, CASE WHEN word = 'w0' THEN p ELSE 0.2e0 END FROM words, (VALUES {", ".join(f"({j}, {p}e0)" for j, p in enumerate(_WARM_B))}) t(j, p), (VALUES (0), (1), (2), (3)) s(i))"""


def _params(models: str, p: str) -> str:
    """{p}p: start and transition probabilities of each model as columns; {p}e: its symbol probabilities by symbol."""
    a = ", ".join(f"sum(p) FILTER (kind = 'a' AND i = {i} AND j = {j}) AS a{i}{j}" for i in range(4) for j in range(4))
    pi = ", ".join(f"sum(p) FILTER (kind = 'pi' AND i = {i}) AS pi{i}" for i in range(4))
    b = ", ".join(f"sum(p) FILTER (i = {i}) AS b{i}" for i in range(4))
    return f"{p}p AS (SELECT word AS model_word, {pi}, {a} FROM {models} GROUP BY word), {p}e AS (SELECT word AS model_word, j AS o, {b} FROM {models} WHERE kind = 'b' GROUP BY word, j)"


def _forward(p: str, own: bool) -> str:
    """{p}al: forward variables by recording, model and t; own: the word's own model only."""
    step = ", ".join(f"({' + '.join(f'r.s{i} * m.a{i}{j}' for i in range(4))}) * e.b{j}" for j in range(4))
    same = "AND m.model_word = s.word" if own else ""
    return f"""{p}al AS (
  SELECT s.word, s.recording, m.model_word, s.t, {", ".join(f"m.pi{i} * e.b{i} AS s{i}" for i in range(4))} FROM sym s JOIN {p}p m ON s.t = 0 {same} JOIN {p}e e ON e.model_word = m.model_word AND e.o = s.o
  UNION ALL
  SELECT s.word, s.recording, r.model_word, s.t, {step} FROM {p}al r JOIN sym s ON s.word = r.word AND s.recording = r.recording AND s.t = r.t + 1 JOIN {p}p m ON m.model_word = r.model_word JOIN {p}e e ON e.model_word = r.model_word AND e.o = s.o)"""


def _loglik(p: str) -> str:
    return f"ends AS (SELECT word, recording, max(t) AS t FROM sym GROUP BY ALL), {p}ll AS (SELECT word, recording, model_word, ln(s0 + s1 + s2 + s3) AS loglik FROM {p}al JOIN ends USING (word, recording, t))"


def _backward(p: str) -> str:
    """{p}be: backward variables under the word's own model; {p}ga and {p}xi: shares of time, and of steps summed over time."""
    step = ", ".join(" + ".join(f"m.a{i}{j} * e.b{j} * r.s{j}" for j in range(4)) for i in range(4))
    ga = " UNION ALL ".join(f"SELECT word, recording, t, {i} AS i, a.s{i} * b.s{i} / q.p AS p FROM {p}al a JOIN {p}be b USING (word, recording, t) JOIN {p}q q USING (word, recording)" for i in range(4))
    xi = " UNION ALL ".join(
        f"SELECT a.word, a.recording, {i} AS i, {j} AS j, sum(a.s{i} * m.a{i}{j} * e.b{j} * b.s{j} / q.p) AS p FROM {p}al a JOIN {p}be b ON b.word = a.word AND b.recording = a.recording AND b.t = a.t + 1 JOIN sym s ON s.word = b.word AND s.recording = b.recording AND s.t = b.t JOIN {p}p m ON m.model_word = a.word JOIN {p}e e ON e.model_word = a.word AND e.o = s.o JOIN {p}q q ON q.word = a.word AND q.recording = a.recording GROUP BY ALL"
        for i in range(4) for j in range(4)
    )
    return f"""ends AS (SELECT word, recording, max(t) AS t FROM sym GROUP BY ALL),
{p}be AS (
  SELECT word, recording, t, 1e0 AS s0, 1e0 AS s1, 1e0 AS s2, 1e0 AS s3 FROM ends
  UNION ALL
  SELECT r.word, r.recording, r.t - 1, {step} FROM {p}be r JOIN sym s ON s.word = r.word AND s.recording = r.recording AND s.t = r.t JOIN {p}p m ON m.model_word = r.word JOIN {p}e e ON e.model_word = r.word AND e.o = s.o WHERE r.t > 0),
{p}q AS (SELECT word, recording, s0 + s1 + s2 + s3 AS p FROM {p}al JOIN ends USING (word, recording, t)),
{p}ga AS ({ga}),
{p}xi AS ({xi})"""


def _m_step(p: str, out: str) -> str:
    return f"""{p}n AS (SELECT word, count(*) AS n FROM ends GROUP BY word),
{p}gt AS (SELECT g.word, g.recording, g.t, g.i, g.p, s.o, g.t < e.t AS before FROM {p}ga g JOIN sym s USING (word, recording, t) JOIN ends e ON e.word = g.word AND e.recording = g.recording),
{p}den AS (SELECT word, i, sum(p) FILTER (before) AS a, sum(p) AS b FROM {p}gt GROUP BY ALL),
{out} AS (
  SELECT word, 'pi' AS kind, i, 0 AS j, sum(p) FILTER (t = 0) / any_value(n) AS p FROM {p}gt JOIN {p}n USING (word) GROUP BY word, i
  UNION ALL SELECT x.word, 'a', x.i, x.j, sum(x.p) / any_value(d.a) FROM {p}xi x JOIN {p}den d ON d.word = x.word AND d.i = x.i GROUP BY x.word, x.i, x.j
  UNION ALL SELECT d.word, 'b', d.i, CAST(k.j AS INT), coalesce(g.p, 0) / d.b + CASE WHEN g.p IS NULL THEN 1e-20 ELSE 0 END FROM {p}den d CROSS JOIN range(5) k(j) LEFT JOIN (SELECT word, i, o, sum(p) AS p FROM {p}gt GROUP BY ALL) g ON g.word = d.word AND g.i = d.i AND g.o = k.j)"""


_EM = (SYM, _START, _params("start", "q"), _forward("q", True), _backward("q"), _m_step("q", "new"))
_NORM = "trained AS (SELECT word, kind, i, j, p / sum(p) OVER (PARTITION BY word, kind, CASE WHEN kind = 'pi' THEN 0 ELSE i END) AS p FROM new)"
_SCORED = (*_EM, _NORM, _params("trained", "z"), _forward("z", False), _loglik("z").removeprefix("ends AS (SELECT word, recording, max(t) AS t FROM sym GROUP BY ALL), "))
_PREDICTED = (*_SCORED, "best AS (SELECT word, recording, model_word AS predicted, loglik FROM (SELECT *, row_number() OVER (PARTITION BY word, recording ORDER BY loglik DESC, model_word) AS r FROM zll) WHERE r = 1)")
_CELLS = f"SELECT word, kind, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {r6('p')} AS p FROM "

_MFCC = f"""bins AS (SELECT k, 16000e0 * k / 64 AS f FROM range(33) t(k)),
edges AS (SELECT m, CASE WHEN mel < 15 THEN mel * 200 / 3 ELSE 1000 * exp(ln(6.4e0) / 27 * (mel - 15)) END AS f FROM (SELECT m, m * (15 + ln(8e0) / (ln(6.4e0) / 27)) / 27 AS mel FROM range(28) t(m))),
mel AS (SELECT a.m, k, CAST(CAST(greatest(0e0, least((b.f - a.f) / (c.f - a.f), (d.f - b.f) / (d.f - c.f))) * 2 / (d.f - a.f) AS FLOAT) AS DOUBLE) AS w FROM bins b CROSS JOIN edges a JOIN edges c ON c.m = a.m + 1 JOIN edges d ON d.m = a.m + 2),
smp AS (SELECT {_KEYS}, unnest(raw_samples) AS x, unnest(range(64)) AS n FROM fr),
dft AS (SELECT {_KEYS}, k, pow(sum(x * h * cos(2 * pi() * ((k * n) % 64) / 64)), 2) + pow(sum(x * h * sin(2 * pi() * ((k * n) % 64) / 64)), 2) AS p FROM (SELECT *, 0.5e0 - 0.5e0 * cos(2 * pi() * n / 64) AS h FROM smp) CROSS JOIN bins GROUP BY ALL),
db AS (SELECT {_KEYS}, m, 10 * log10(greatest(1e-10, sum(p * w))) AS s FROM dft JOIN mel USING (k) GROUP BY ALL),
clamped AS (SELECT {_KEYS}, m, greatest(s, max(s) OVER (PARTITION BY {_KEYS}) - 80) AS s FROM db)"""

SQL = {
    "sg1_time_axis": with_(SIG, out=f"SELECT word, recording, idx, {r6(f'idx / {RATE}.0e0')} AS t, {r6('x')} AS x FROM sig"),
    "sg2_preemphasis": with_(SIG, PRE, out=_LONG + "pre"),
    "sg3_short_time_stats": with_(SIG, PRE, _stats("pre", "s"), out=f"SELECT word, recording, CAST(frame AS BIGINT) AS frame, {r6('power')} AS power, {r6('zcr')} AS zcr FROM sst"),
    "sg4_trim_silence": with_(SIG, PRE, _stats("pre", "s"), _cut("pre", "s", *_ONE), out=_LONG + "sout"),
    "sg5_trim_two_level": with_(SIG, PRE, _stats("pre", "s"), _cut("pre", "s", *_TWO), out=_LONG + "sout"),
    "sg6_hamming": with_(SIG, _hamming("sig", "h"), out=_LONG + "hout"),
    "sg7_preprocess": with_(SIG, PRE, _stats("pre", "s"), _cut("pre", "s", *_BATCH), _stats("pre", "l"), _cut("pre", "l", *_LIVE), _hamming("lout", "h"), out=f"SELECT 'batch' AS mode, word, recording, idx, {r6('x')} AS x FROM sout UNION ALL SELECT 'live', word, recording, idx, {r6('x')} FROM hout"),
    "sg8_drop_leading": with_(SIG, out=f"SELECT word, recording, idx - 5 AS idx, {r6('x')} AS x FROM sig WHERE idx >= 5"),
    "sp1_assign_purposes": with_(SIG, _purposes("sig"), out="SELECT word, recording, purpose FROM purposes"),
    "sp2_assignment_counts": with_(FR64, _purposes("fr"), out="SELECT purpose, word, count(DISTINCT recording) AS recordings, count(*) AS frames, CAST(grouping(purpose, word) AS INT) AS level FROM fr JOIN purposes USING (word, recording) GROUP BY ROLLUP (purpose, word)"),
    "sp3_sample_per_group": with_(SIG, out="SELECT word, recording FROM (SELECT word, recording, row_number() OVER (PARTITION BY word ORDER BY md5(recording || 'seed7'), recording) AS r FROM (SELECT DISTINCT word, recording FROM sig)) WHERE r <= 3"),
    "fr1_split_frames": with_(SIG, _frames("sig", FRAME, HOP, 9), out="SELECT word, recording, frame_number, n, total FROM frames"),
    "fr2_build_frames": with_(SIG16, _purposes("sig"), _frames("sig", 320, 160, 13), out="SELECT purpose, word, recording, frame_number, n, total FROM frames JOIN purposes USING (word, recording)"),
    "ft1_mfcc": with_(FR64, _MFCC, out=f"SELECT {_KEYS}, CAST(q AS INT) AS pos, {r6('sum(s * cos(pi() * q * (m + 0.5e0) / 26) * CASE WHEN q = 0 THEN sqrt(1e0 / 26) ELSE sqrt(2e0 / 26) END)')} AS v FROM clamped CROSS JOIN range(13) t(q) GROUP BY ALL"),
    "ft2_autocorrelation": with_(FR64, f"smp AS (SELECT {_KEYS}, unnest(raw_samples) AS x, unnest(range(64)) AS n FROM fr)", out=f"SELECT a.word, a.recording, a.frame_number, CAST(b.n - a.n AS INT) AS pos, {r6('sum(a.x * b.x)')} AS v FROM smp a JOIN smp b ON a.word = b.word AND a.recording = b.recording AND a.frame_number = b.frame_number AND b.n >= a.n AND b.n - a.n <= 12 GROUP BY ALL"),
    "vq1_initial_centroid": with_(FR64, _EACH, _MEAN, out=f"SELECT 0 AS id, pos, {r6('v')} AS v FROM mean"),
    "vq2_split_codebook": with_(FR64, _EACH, _MEAN, _FOUR, out=_BOOK + "four"),
    "vq3_assign_nearest": with_(*_ASSIGNED, out=f"SELECT {_KEYS}, parent_centroid_id, {r6('distance')} AS distance FROM near"),
    "vq4_itakura_saito": with_(
        FR64, f"smp AS (SELECT {_KEYS}, unnest(raw_samples) AS x, unnest(range(64)) AS n FROM fr)",
        "ac AS (SELECT a.word, a.recording, a.frame_number, b.n - a.n AS lag, sum(a.x * b.x) AS r FROM smp a JOIN smp b ON a.word = b.word AND a.recording = b.recording AND a.frame_number = b.frame_number AND b.n >= a.n AND b.n - a.n <= 12 GROUP BY ALL)",
        "lp AS (SELECT id, n, CASE WHEN n = 0 THEN 1e0 ELSE (id + 1) * 0.1e0 / n * (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) END AS c FROM range(4) t(id), range(13) u(n))",
        "ra AS (SELECT a.id, b.n - a.n AS lag, sum(a.c * b.c) AS r FROM lp a JOIN lp b ON a.id = b.id AND b.n >= a.n GROUP BY ALL)",
        f"d AS (SELECT {_KEYS}, id, abs(sum(ac.r * ra.r * CASE WHEN lag = 0 THEN 1 ELSE 2 END)) AS d FROM ac JOIN ra USING (lag) GROUP BY ALL)",
        out=f"SELECT {_KEYS}, CAST(id AS INT) AS parent_centroid_id, {r6('d')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY d, id) AS r FROM d) WHERE r = 1",
    ),
    "vq5_update_codebook": with_(*_ASSIGNED, _update("near", "upd", 4), out=_BOOK + "upd"),
    "vq6_train_codebook": with_(FR64, _EACH, _MEAN, "one AS (SELECT 0 AS id, pos, v FROM mean)", _split("one", "c0"), _assign("c0", "n0"), _update("n0", "c1", 2), _assign("c1", "n1"), _update("n1", "c2", 2), out=_BOOK + "c2"),
    "vq7_quantize": with_(*_ASSIGNED, _update("near", "upd", 4), _assign("upd", "sy"), out="SELECT word, recording, string_agg(CAST(parent_centroid_id AS VARCHAR), ',' ORDER BY frame_number) AS obs FROM sy GROUP BY ALL"),
    "vq8_training_summary": with_(*_ASSIGNED, out="SELECT CAST(sum(count(*)) OVER () AS BIGINT) AS total_frames, 2 AS max_generation, parent_centroid_id AS centroid, count(*) AS n FROM near GROUP BY parent_centroid_id"),
    "qa1_frame_quality_mfcc": with_(
        FR64, _FAULTY, f"e AS (SELECT {_KEYS}, unnest(mfcc) AS v FROM faulty)", f"m AS (SELECT {_KEYS}, sqrt(sum(v * v)) AS m, count(*) AS n, max(abs(v)) <= 1e-8 AS z FROM e GROUP BY ALL)",
        out=f"SELECT count(*) AS total_frames, count(*) FILTER (NOT z) AS valid_mfcc, {r6('min(64)')} AS length_min, {r6('max(64)')} AS length_max, {r6('avg(64)')} AS length_mean, {r6('min(m)')} AS magnitude_min, {r6('max(m)')} AS magnitude_max, {r6('avg(m)')} AS magnitude_mean, CAST(sum(CAST(z AS INT) + CAST(n <> 13 AS INT)) AS BIGINT) AS issues FROM m",
    ),
    "qa2_frame_quality_lpc": with_(FR64, out="SELECT count(*) AS total_frames, count(*) AS valid_autocorr, count(*) FILTER (frame_number % 3 <> 0) AS valid_lpc, count(*) FILTER (frame_number % 4 <> 0) AS valid_lsf, CAST(count(*) FILTER (frame_number % 3 = 0) + count(*) FILTER (frame_number % 4 = 0) AS BIGINT) AS issues FROM fr"),
    "qa3_assignment_report": with_(*_ASSIGNED, out="SELECT 'centroid' AS kind, CAST(parent_centroid_id AS VARCHAR) AS value, count(*) AS n FROM near GROUP BY ALL UNION ALL SELECT 'generation', '2', count(*) FROM near UNION ALL SELECT 'recording', word || '/' || recording, count(*) FROM near GROUP BY word, recording UNION ALL SELECT 'all', '', count(*) FROM near"),
    "qa4_usage_stats": with_(*_ASSIGNED, "n AS (SELECT 'centroid' AS per, count(*) AS n FROM near GROUP BY parent_centroid_id UNION ALL SELECT 'recording', count(*) FROM near GROUP BY word, recording)", out=f"SELECT per, min(n) AS min, max(n) AS max, {r6('avg(n)')} AS mean, {r6('stddev_pop(n)')} AS std FROM n GROUP BY per"),
    "qa5_histogram": with_(FR64, _EACH, _MAG, "ends AS (SELECT min(m) AS a, max(m) AS b FROM mag)", "c AS (SELECT CAST(least(floor((m - a) / (b - a) * 30), 29) AS INT) AS bin, count(*) AS n FROM mag, ends GROUP BY ALL)", out=f"SELECT CAST(g.bin AS INT) AS bin, {r6('a + g.bin * ((b - a) / 30)')} AS lo, {r6('a + (g.bin + 1) * ((b - a) / 30)')} AS hi, coalesce(n, 0) AS n FROM range(30) g(bin) CROSS JOIN ends LEFT JOIN c ON c.bin = g.bin"),
    "qa6_downsample": with_(FR64, _EACH, _MAG, f"o AS (SELECT *, row_number() OVER (ORDER BY {_KEYS}) - 1 AS i, count(*) OVER () AS n FROM mag)", out=f"SELECT CAST(i AS BIGINT) AS i, {_KEYS}, {r6('m')} AS m FROM o WHERE i % greatest(1, n // 100) = 0"),
    "qa7_codebook_stats": with_(FR64, _EACH, _MEAN, _FOUR, "m AS (SELECT id, sqrt(sum(v * v)) AS m FROM four GROUP BY id)", out=f"SELECT count(*) AS n, {r6('min(m)')} AS min, {r6('max(m)')} AS max, {r6('avg(m)')} AS mean, {r6('stddev_pop(m)')} AS std FROM m"),
    "qa8_top_issues": with_(FR64, "bad AS (SELECT word, recording, frame_number, CASE frame_number WHEN 5 THEN 'zero_mfcc' ELSE 'wrong_mfcc_size_12' END AS issues FROM fr WHERE frame_number IN (3, 5))", out="SELECT *, (SELECT greatest(count(*) - 5, 0) FROM bad) AS rest FROM bad ORDER BY word, recording, frame_number LIMIT 5"),
    "hm1_log_sum_exp": with_("t AS (SELECT user_id, -value AS v FROM events)", "m AS (SELECT user_id, max(v) AS m FROM t GROUP BY ALL)", "l AS (SELECT user_id, ln(sum(exp(v - m))) + any_value(m) AS lse FROM t JOIN m USING (user_id) GROUP BY ALL)", out=f"SELECT user_id, {r6('lse')} AS lse, {r6('lse')} AS of_array, {r6('greatest(-lse, 0)')} AS back FROM l"),
    "hm2_initial_model": with_(SYM, _START, out=_CELLS + "start"),
    "hm3_forward": with_(SYM, _START, _params("start", "q"), _forward("q", False), _loglik("q"), out=f"SELECT word, recording, model_word, {r6('loglik')} AS loglik FROM qll", recursive=True),
    "hm4_forward_backward": with_(*_EM[:-1], out=f"SELECT word, recording, 'gamma' AS kind, t, i, 0 AS j, {r6('p')} AS p FROM qga UNION ALL SELECT word, recording, 'xi', -1, i, j, {r6('p')} FROM qxi", recursive=True),
    "hm5_m_step": with_(*_EM, out=_CELLS + "new", recursive=True),
    "hm6_train_hmms": with_(*_EM, _NORM, out=_CELLS + "trained", recursive=True),
    "sc1_trained_only": with_(SYM, out="SELECT word, recording, CAST(count(*) AS INT) AS n FROM sym WHERE word < 'w7' GROUP BY ALL"),
    "sc2_predict": with_(*_PREDICTED, out=f"SELECT word, recording, predicted, {r6('loglik')} AS loglik FROM best", recursive=True),
    "sc3_rank_models": with_(*_SCORED, out=f"SELECT word, recording, model_word, CAST(row_number() OVER (PARTITION BY word, recording ORDER BY loglik DESC, model_word) AS INT) AS rank, {r6('loglik')} AS loglik FROM zll", recursive=True),
    "sc4_confusion_matrix": with_("p AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS q FROM labels)", "l AS (SELECT t AS v FROM p UNION SELECT q FROM p)", out=f"SELECT a.v AS true, b.v AS predicted, (SELECT count(*) FROM p WHERE t = a.v AND q = b.v) AS n, (SELECT {r6('avg(CASE WHEN t = q THEN 1e0 ELSE 0 END) * 100')} FROM p) AS accuracy FROM l a, l b"),
    "sc5_classification_report": with_(
        *_PREDICTED, "lab AS (SELECT word AS v FROM best UNION SELECT predicted FROM best)",
        "cnt AS (SELECT v AS label, (SELECT count(*) FROM best WHERE word = v AND predicted = v) AS hit, (SELECT count(*) FROM best WHERE predicted = v) AS said, (SELECT count(*) FROM best WHERE word = v) AS support FROM lab)",
        "pr AS (SELECT label, support, hit, CASE WHEN said = 0 THEN 0e0 ELSE hit / said END AS p, CASE WHEN support = 0 THEN 0e0 ELSE hit / support END AS r FROM cnt)",
        "f AS (SELECT *, CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)",
        out=f"""SELECT label, {r6('p')} AS precision, {r6('r')} AS recall, {r6('f1')} AS f1, support FROM f
UNION ALL SELECT 'accuracy', {r6('sum(hit) / sum(support)')}, {r6('sum(hit) / sum(support)')}, {r6('sum(hit) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', {r6('avg(p)')}, {r6('avg(r)')}, {r6('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', {r6('sum(p * support) / sum(support)')}, {r6('sum(r * support) / sum(support)')}, {r6('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM f""", recursive=True,
    ),
    "io1_wav_corpus": with_(SIG16, out=f"SELECT word, recording, 16000 AS framerate, 1 AS nchannels, count(*) AS nframes, {r6('sum(x * 100)')} AS total, {r6('arg_max(x * 100, idx)')} AS last FROM sig GROUP BY ALL"),
    "io2_standardize": with_(SIG16, out=f"SELECT word, recording, 16000 AS framerate, 1 AS nchannels, count(*) AS nframes, 'stereo' AS reasons, {r6('sum(2 * x)')} AS total FROM sig GROUP BY ALL"),
    "io3_processed": with_(SIG, PRE, _stats("pre", "s"), _cut("pre", "s", *_BATCH), out=_LONG + "sout"),
    "io4_frames": with_(SIG16, _purposes("sig"), _frames("sig", 320, 160, 13), out="SELECT purpose, word, recording, frame_number, n, total FROM frames JOIN purposes USING (word, recording) WHERE purpose = 'hmm'"),
    "io5_codebook": with_(FR64, _EACH, _MEAN, _FOUR, "one AS (SELECT 0 AS id, pos, v FROM mean)", _split("one", "two"), out=" UNION ALL ".join(f"SELECT {g} AS generation, id, pos, {r6('v')} AS v FROM {t}" for g, t in enumerate(("one", "two", "four")))),
    "io6_models": with_(SYM, _START, out=f"SELECT 'all' AS read, word, kind, i, j, {r6('p')} AS p FROM start UNION ALL SELECT 'one', word, kind, i, j, {r6('p')} FROM start WHERE word = 'w0'"),
    "st2_assemble_clips": with_("t AS (SELECT user_id AS recorder, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)", out=f"SELECT recorder, CAST(idx // 16 AS BIGINT) AS clip, CAST(count(*) AS INT) AS n, {r6('sum(value)')} AS total FROM t GROUP BY recorder, idx // 16 HAVING count(*) = 16"),
}

#: The chunked operators have the rows of those on arrays.
SQL |= {f"{name}_chunked": SQL[name] for name in ("sg2_preemphasis", "sg3_short_time_stats", "sg4_trim_silence", "sg5_trim_two_level", "sg6_hamming", "sg7_preprocess")}
SQL |= {
    "io4_frames_json": with_(
        FR64, f"z AS (SELECT *, CAST(regexp_extract(recording, '-([0-9]+)$', 1) AS INT) % 3 AS s, list_sum(mfcc) AS m FROM fr)",
        f"smp AS (SELECT {_KEYS}, unnest(raw_samples) AS x, unnest(range(64)) AS n FROM fr)",
        f"ac AS (SELECT a.word, a.recording, a.frame_number, sum(a.x * b.x) AS r FROM smp a JOIN smp b ON a.word = b.word AND a.recording = b.recording AND a.frame_number = b.frame_number AND b.n >= a.n AND b.n - a.n <= 12 GROUP BY ALL)",
        out=f"""SELECT {_KEYS}, CASE s WHEN 0 THEN 'mfcc' WHEN 1 THEN 'lpc' ELSE 'raw' END AS shape, CASE WHEN s < 2 THEN 1 ELSE -1 END AS generation, CASE WHEN s < 2 THEN frame_number ELSE -1 END AS parent_centroid_id, {r6('list_sum(raw_samples)')} AS raw_samples,
CASE s WHEN 0 THEN {r6('m')} END AS mfcc, CASE WHEN s > 0 THEN {r6('r')} END AS autocorr, CASE s WHEN 1 THEN {r6('m')} END AS lpc, CASE s WHEN 1 THEN {r6('m - mfcc[1]')} END AS lsf FROM z JOIN ac USING ({_KEYS})""",
    ),
    "io5_codebook_lsf": with_(
        FR64, _EACH, _MEAN, _FOUR, "s AS (SELECT id, sum(v) AS a, sum(v) FILTER (pos > 0) AS b FROM four GROUP BY id)",
        out=f"SELECT id % 2 AS generation, id, 'lsf' AS shape, {r6('b')} AS vec, {r6('a')} AS lpc FROM s UNION ALL SELECT -1, id, 'lsf', {r6('b')}, {r6('a')} FROM s UNION ALL SELECT -1, id, 'mfcc', {r6('a')}, NULL FROM s",
    ),
    "io6_models_json": SQL["io6_models"],
}
SQL["st2_clips_by_start"] = with_("t AS (SELECT user_id AS recorder, value, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)", out=f"SELECT recorder, epoch_us(arg_min(ts, idx)) AS us, arg_min(event_id, idx) AS seq, CAST(0 AS INT) AS first, CAST(count(*) AS INT) AS n, {r6('sum(value)')} AS total FROM t GROUP BY recorder, idx // 16 HAVING count(*) = 16")
SQL |= {"hm3_forward_blocks": SQL["hm3_forward"], "hm4_forward_backward_blocks": SQL["hm4_forward_backward"], "sc2_predict_blocks": SQL["sc2_predict"]}
_SETS = ", ".join(f"CAST(string_agg(DISTINCT CAST({c} AS VARCHAR), ',' ORDER BY CAST({c} AS VARCHAR)) AS VARCHAR) AS {c}s" for c in ("centroid", "generation"))
SQL |= {
    "qa3_grouping_sets": with_(*_ASSIGNED, "g AS (SELECT word, recording, CAST(parent_centroid_id AS VARCHAR) AS centroid, CAST(frame_number % 3 AS VARCHAR) AS generation FROM near)", out=" UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {', '.join(f'{c} AS {c}' if c in by else f'{chr(39) * 2} AS {c}' for c in ('centroid', 'generation', 'word', 'recording'))}, n, centroids, generations FROM (SELECT {', '.join((*by, 'count(*) AS n', _SETS))} FROM g {'GROUP BY ALL' * bool(by)})"
        for kind, by in (("all", ()), ("centroid", ("centroid",)), ("generation", ("generation",)), ("recording", ("word", "recording"))))),
    "sc4_confusion_dense": with_("p AS (SELECT a.lang AS t, CASE WHEN b.lang IN ('de', 'en', 'xx') THEN b.lang ELSE 'unlisted' END AS q FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)", "l(place, label) AS (VALUES (0, 'de'), (1, 'en'), (2, 'xx'))", out=f"SELECT CAST(place AS INT) AS place, label AS true, {', '.join(f'count(*) FILTER (q = {chr(39)}{c}{chr(39)}) AS {c}' for c in ('de', 'en', 'xx', 'unlisted'))}, {r6('coalesce(avg(CASE WHEN t = q THEN 1e0 WHEN t IS NOT NULL THEN 0e0 END) * 100, -1e0)')} AS hits FROM l LEFT JOIN p ON t = label GROUP BY place, label"),
}
