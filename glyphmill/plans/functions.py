"""The library from Spark SQL: row-local operators as SQL functions, which the optimizer inlines, and windows as a table function.

    register(spark)
    SELECT doc_id, w.* FROM (SELECT doc_id, text_segments(text) AS segs FROM documents) d, LATERAL text_windows(CAST(doc_id AS STRING), d.segs) w
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..functions.profile import IGNORE, LATIN, OTHER, PAUSE, TARGET, Profile
from ..functions.rng import PHI
from ..functions.text import INITIAL
from ..operators.segment import Cut, runs_pattern, window_bounds, window_lists

SEGMENT = "STRUCT<text: STRING, label: INT>"


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def definitions(p: Profile = LATIN) -> dict[str, tuple[str, str, str]]:
    """Name, then parameters, type and expression of each function."""
    t, pause = f"[{p.target}]", f"[{p.pause}]"
    label = f"CASE WHEN x RLIKE {quoted('^' + pause)} THEN {PAUSE} WHEN x RLIKE {quoted('^' + t)} THEN {TARGET} ELSE {OTHER} END"
    first = f"regexp_extract(s, {quoted(INITIAL)}, 1)"
    return {
        "strip_brackets": ("t STRING", "STRING", f"regexp_replace(t, {quoted(r'\[[^\]]+\]')}, '')"),
        "join_spaced": ("t STRING", "STRING", f"regexp_replace(t, {quoted(rf'(?U)({t})\s+({t})')}, '$1$2')"),
        "keep_text": ("t STRING", "STRING", f"regexp_replace(t, {quoted(f'[^{p.target}{p.pause}]')}, '')"),
        "target_ratio": ("t STRING", "DOUBLE", f"CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, {quoted(f'[{p.ratio}]+')}, ''))) / length(t) ELSE 0.0 END"),
        "text_eligible": ("t STRING, least DOUBLE", "BOOLEAN", "length(t) > 1 AND target_ratio(t) >= least"),
        "text_runs": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {quoted(runs_pattern(p))}, 1)"),
        "text_segments": ("t STRING", f"ARRAY<{SEGMENT}>", f"filter(transform(text_runs(t), x -> named_struct('text', CASE WHEN x RLIKE {quoted('^' + pause)} THEN substring(x, 1, 1) ELSE x END, 'label', {label})), s -> s.label <> {OTHER} OR length(s.text) <= 16)"),
        "syllable_initial": ("s STRING", "STRING", first),
        "syllable_final": ("s STRING", "STRING", f"regexp_replace(s, {quoted(INITIAL)}, '')"),
        "shorthands": ("s STRING", "ARRAY<STRING>", f"CASE WHEN s = '' THEN CAST(array() AS ARRAY<STRING>) WHEN length({first}) = 2 THEN array({first}, left({first}, 1)) WHEN length({first}) = 1 THEN array({first}) ELSE array(left(s, 1)) END"),
        "draw": ("seed STRING, salt STRING, k STRING", "DOUBLE", "CAST(conv(substring(md5(concat_ws(':', seed, salt, k)), 1, 13), 16, 10) AS BIGINT) / 4503599627370496.0D"),
        "golden": ("t STRING, epoch INT, n INT", "INT", f"CASE WHEN n <= 1 THEN 1 ELSE least(CAST(floor((CAST(CAST(conv(substring(md5(t), 1, 16), 16, 10) AS DECIMAL(20, 0)) AS DOUBLE) / 18446744073709551616.0D + epoch * {PHI}D) % 1 * n) AS INT), n - 1) + 1 END"),
        "vocabulary_ids": ("t STRING, vocabulary STRING", "ARRAY<INT>", "filter(transform(filter(split(t, ''), c -> c <> ''), c -> position(c, vocabulary) - 1), i -> i >= 0)"),
        "vocabulary_aligned": ("t STRING, vocabulary STRING", "ARRAY<INT>", f"transform(filter(split(t, ''), c -> c <> ''), c -> CASE WHEN position(c, vocabulary) = 0 THEN {IGNORE} ELSE position(c, vocabulary) - 1 END)"),
    }


class TextWindows:
    """The windows of one text's segments: start, text_list, labels; as ``operators.segment.windows`` cuts them.

    A worker holds all rows of an Arrow batch as objects; for large tables there is ``text_window_list``.
    """

    def eval(self, key: str, segs: list[Row], seed: int = 0, shortest: int = 16, longest: int = 64, soft: int = 72, hard: int = 96) -> Iterator[tuple[int, list[str], list[int]]]:
        if not segs:
            return
        cut = Cut(seed, shortest, longest, soft, hard)
        labels = np.array([s["label"] for s in segs])
        lengths = np.array([len(s["text"]) for s in segs])
        for i, j in window_bounds(lengths, labels, lambda i: cut.draw(key, i), cut):
            if (labels[i:j] == TARGET).any():
                yield i, [s["text"] for s in segs[i:j]], labels[i:j].tolist()


def register_lists(spark: SparkSession, cut: Cut = Cut()) -> None:
    """text_window_list(key, segments): the windows of ``text_windows`` as one list, cut in Arrow parts; ``LATERAL VIEW inline`` makes them rows."""
    spark.udf.register("text_window_list", window_lists(cut))


def register(spark: SparkSession, p: Profile = LATIN) -> list[str]:
    """Make all functions known to a session; gives their names."""
    found = definitions(p)
    for name, (parameters, kind, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("text_windows", F.udtf(TextWindows, returnType="start INT, text_list ARRAY<STRING>, labels ARRAY<INT>", useArrow=True))
    return [*found, "text_windows"]
