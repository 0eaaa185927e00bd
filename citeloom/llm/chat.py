r"""Chat formatting in budgeted windows. DataFrame functions only; one shuffle, by conversation.

A conversation's turns, in order of turn (ties by role, then text), are rendered as ``<|im_start|>role\ntext<|im_end|>\n``.
Control strings inside a text get a backslash after their first character, after any backslashes that stand there
already, and a role's backslashes and line feeds are written ``\\`` and ``\n``: both can be undone exactly.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans that fit the budget (a turn that is longer
alone is a span of its own). The first window holds the first span. Every later one begins with the system turn, if
the conversation begins with one, and with the last turns before its span, at most ``history_turns`` and
``history_tokens`` of them. Assistant turns are targets in the window where they are new and masked where they are
repeated, so that each target counts once.

Null texts and roles are empty. A null turn comes first. Repeated rows are turns of their own. Rows with a null
conv_id make one conversation with that id. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"\||/?s>|/?INST\]|</?SYS>>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 512, 2, 128
TARGET, SYSTEM = "assistant", "system"
#: Values whose running results are appended one by one; chunks of them are appended as wholes.
CHUNK = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*+)({CONTROL})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\({CONTROL})", "$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def _scan(values: Column, state: Column, step, out: str) -> Column:
    """The arrays that ``step`` adds to, over ``values``: state -> {next state, ``out``: array of what is added}.

    The values are taken in chunks, so that appending copies a chunk and not all that came before: ``state`` goes from
    chunk to chunk beside an array of the chunks' results.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))

    def through(a: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(a["state"].alias("state"), F.array().cast(out).alias("new")), step)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(a["new"], F.array(d["new"])).alias("new")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("new"))
    return F.when(F.size(values) > 0, F.aggregate(chunks, start, through, lambda a: F.flatten(a["new"]))).otherwise(F.array().cast(out))


def _sums(numbers: Column) -> Column:
    """Prefix sums: element i is the total of the first i numbers."""
    def step(a: Column, x: Column) -> Column:
        return F.struct((a["state"] + x).alias("state"), F.concat(a["new"], F.array(a["state"] + x)).alias("new"))

    zero = F.lit(0).cast("long")
    return F.concat(F.array(zero), _scan(numbers, zero, step, "array<bigint>"))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and ``turns``: array of {role, text, rendered, tokens, chars}, role and text escaped."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select(F.col("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def shown(t: Column) -> Column:
        def whole(s: Column) -> Column:
            rendered = F.concat(F.lit(OPEN), s["role"], F.lit("\n"), s["text"], F.lit(CLOSE))
            return let(rendered, lambda r: F.struct(
                s["role"].alias("role"), s["text"].alias("text"), r.alias("rendered"),
                F.ceil(F.octet_length(r) / 4).cast("long").alias("tokens"), F.length(r).cast("long").alias("chars"),
            ))

        return let(F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")), whole)

    return grouped.select("conv_id", F.transform("t", shown).alias("turns"))


def _windows(turns: Column, budget: int, history_turns: int, history_tokens: int) -> Column:
    """Elements are taken first and their fields then: a field of an array of structs would copy the whole array."""
    long = lambda x: F.lit(x).cast("long")

    def planned(s: Column) -> Column:
        t, p, q = s["t"], s["p"], s["q"]
        n = F.size(t)
        system = F.when(F.get(t, F.lit(0))["role"] == SYSTEM, 1).otherwise(0)
        room = F.greatest(F.lit(budget - history_tokens) - system * F.get(p, F.lit(1)), long(1))

        def step(a: Column, i: Column) -> Column:
            new = (i == 0) | (F.get(p, i + 1) - a["state"] > room)
            return F.when(new, F.struct(F.get(p, i).alias("state"), F.concat(a["new"], F.array(i)).alias("new"))).otherwise(a)

        starts = _scan(F.sequence(F.lit(0), n - 1), long(0), step, "array<int>")

        def window(u: Column) -> Column:
            def one(a: Column, w: Column) -> Column:
                b = F.coalesce(F.get(u["starts"], w + 1), n)
                back = F.size(F.filter(F.array(*(F.lit(k) for k in range(1, history_turns + 1))), lambda k: (a - k >= system) & (F.get(p, a) - F.get(p, F.greatest(a - k, F.lit(0))) <= history_tokens))) if history_turns else F.lit(0)
                joined = lambda first, size: F.array_join(F.transform(F.slice(t, first + 1, size), lambda x: x["rendered"]), "")
                head = F.when(w == 0, F.lit("")).otherwise(F.concat(F.when(system == 1, F.get(t, F.lit(0))["rendered"]).otherwise(F.lit("")), joined(a - back, back)))

                def built(h: Column) -> Column:
                    fresh = F.length(h["head"]).cast("long")

                    def span(x: Column, i: Column) -> Column:
                        start = fresh + F.get(q, a + i) - F.get(q, a) + len(OPEN) + 1 + F.length(x["role"])
                        return F.struct(start.alias("start"), (fresh + F.get(q, a + i + 1) - F.get(q, a) - len(CLOSE)).alias("end"), x["role"].alias("role"))

                    spans = F.transform(F.slice(t, a + 1, b - a), span)
                    loss = F.transform(F.filter(spans, lambda x: x["role"] == TARGET), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
                    return F.struct(w.alias("window"), F.concat(h["head"], joined(a, b - a)).alias("formatted"), fresh.alias("fresh_from"), loss.alias("loss"))

                return let(F.struct(head.alias("head")), built)

            return F.transform(u["starts"], one)

        return let(F.struct(starts.alias("starts")), window)

    sums = lambda field: _sums(F.transform(turns, lambda t: t[field]))
    return let(F.struct(turns.alias("t"), sums("tokens").alias("p"), sums("chars").alias("q")), planned)


def format_windows(rows: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id and ``windows``: array of {window, formatted, fresh_from, loss}.

    ``fresh_from``: code points of repeated turns at the beginning; ``loss``: {start, end} in code points of the targets.
    """
    return conversations(rows).select("conv_id", _windows(F.col("turns"), budget, history_turns, history_tokens).alias("windows"))


def format_chat(rows: DataFrame, **limits: int) -> DataFrame:
    """One row for each window: conv_id, window, formatted, fresh_from, loss."""
    return format_windows(rows, **limits).select("conv_id", F.explode("windows").alias("w")).select("conv_id", "w.*")


def turns_of(formatted: Column, fresh_from: Column) -> Column:
    """The new turns of a window as {role, text}, read back from what was written."""
    pieces = F.split(formatted.substr((fresh_from + 1).cast("int"), F.length(formatted)), r"<\|im_end\|>\n", -1)

    def read(x: Column) -> Column:
        cut = F.locate("\n", x)
        return F.struct(unescape_role(x.substr(F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescape(x.substr(cut + 1, F.length(x))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), read)


def digest(windows: DataFrame) -> DataFrame:
    """The contract's row for each conversation of ``format_windows``, read back from the formatted texts."""
    w = F.col("windows")
    turns = F.flatten(F.transform(w, lambda x: turns_of(x["formatted"], x["fresh_from"])))
    masked = F.flatten(F.transform(w, lambda x: F.transform(x["loss"], lambda s: unescape(x["formatted"].substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))))
    read = windows.select("conv_id", let(turns, lambda t: F.struct(F.size(t).cast("long").alias("n"), F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("all"))).alias("t"), F.array_join(masked, "").alias("loss"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x["formatted"])).alias("formatted_chars"))
    return read.select("conv_id", F.col("t.n").alias("n_turns"), F.sha2(F.col("t.all"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")


#: DuckDB: the same, the windows found by walking from each span's first turn to the next one's.
SQL = rf"""
WITH RECURSIVE rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text,
    '{OPEN}' || replace(replace(regexp_replace(coalesce(role, ''), '([<\[])(\\*)({CONTROL})', '\1\2\\\3', 'g'), '\', '\\'), chr(10), '\n') || chr(10)
    || regexp_replace(coalesce(text, ''), '([<\[])(\\*)({CONTROL})', '\1\2\\\3', 'g') || '<|im_end|>' || chr(10) AS r FROM rows_),
p AS (
  SELECT *, ceil(strlen(r) / 4.0) AS k, sum(ceil(strlen(r) / 4.0)) OVER (PARTITION BY conv_id ORDER BY i) AS upto, length(r) AS chars,
    first_value(role) OVER (PARTITION BY conv_id ORDER BY i) = '{SYSTEM}' AS sys, first_value(ceil(strlen(r) / 4.0)) OVER (PARTITION BY conv_id ORDER BY i) AS k0,
    first_value(length(r)) OVER (PARTITION BY conv_id ORDER BY i) AS c0, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
walk AS (
  SELECT conv_id, i AS a FROM p WHERE i = 0
  UNION ALL
  SELECT w.conv_id, min(x.i) FROM walk w JOIN p s ON s.conv_id = w.conv_id AND s.i = w.a JOIN p x ON x.conv_id = w.conv_id AND x.i > w.a
    AND x.upto - (s.upto - s.k) > greatest({BUDGET} - {HISTORY_TOKENS} - CASE WHEN s.sys THEN s.k0 ELSE 0 END, 1) GROUP BY w.conv_id, w.a),
again AS (
  SELECT w.conv_id, w.a, sum(CASE WHEN h.i >= w.a - {HISTORY_TURNS} AND h.i >= CASE WHEN h.sys THEN 1 ELSE 0 END AND (s.upto - s.k) - (h.upto - h.k) <= {HISTORY_TOKENS} THEN h.chars ELSE 0 END) + max(CASE WHEN h.sys THEN h.c0 ELSE 0 END) AS chars
  FROM walk w JOIN p s ON s.conv_id = w.conv_id AND s.i = w.a JOIN p h ON h.conv_id = w.conv_id AND h.i < w.a GROUP BY w.conv_id, w.a),
extra AS (SELECT conv_id, sum(chars) AS chars FROM again GROUP BY conv_id)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{TARGET}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{TARGET}'), '')) AS loss_sha256,
  CAST(sum(p.chars) + coalesce(max(extra.chars), 0) AS BIGINT) AS formatted_chars
FROM p LEFT JOIN extra ON extra.conv_id IS NOT DISTINCT FROM p.conv_id GROUP BY p.conv_id
"""
