"""G1, P7 and P8 as a stream: generation rounds are folded while they arrive.

Each (repeat, question) has a state of its own: what its rounds from 0 on amount to so far, and rounds that
came before their turn. When a round lands, the question's folded row is emitted again, and
with it whether another round is to be generated; a question that stops, or has had its last round, is closed and its
texts leave the state. What has landed equals the batch fold of all rounds, whatever the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import ROUND_KEYS
from . import COMPACT_EVERY, landed, latest, write_changes

_ROW = ("text string, initial_round_text string, prompt_tokens long, output_tokens long, initial_round_output_tokens long, "
        "continuation_output_tokens long, was_truncated boolean, still_truncated boolean, num_rounds int, last_round int, is_closed boolean")


def _folder(keys):
    """The function that Spark calls with a question's new rounds and its state; it holds all it needs, so workers import nothing of this package."""
    def fold(key, frames, state):
        import json

        import pandas as pd

        def plain(v):
            return None if pd.isna(v) else v.item() if hasattr(v, "item") else v

        s = json.loads(state.get[0]) if state.exists else {"last": -1, "closed": False, "early": {}, "text": "", "first": None, "out": 0, "fin": None}
        grew, limit = False, None
        for frame in frames:
            for r in frame.itertuples(index=False):
                at = int(r.round)
                if at <= s["last"] or str(at) in s["early"]:
                    raise ValueError(f"a round occurs twice for {dict(zip(keys, key))}")
                s["early"][str(at)] = [plain(r.text), plain(r.prompt_tokens), plain(r.output_tokens), plain(r.finish_reason), int(r.max_rounds)]
        while not s["closed"] and str(s["last"] + 1) in s["early"]:
            text, prompt, out, fin, limit = s["early"].pop(str(s["last"] + 1))
            s["last"] += 1
            if s["last"] == 0:
                s["first"] = [text, prompt, out, fin]
            s["text"] += text or ""
            s["out"] += out or 0
            s["fin"], s["closed"], grew = fin, fin != "length" or s["last"] >= limit, True
        if grew:
            text, prompt, out, fin = s["first"]
            row = (*key, s["text"], text, prompt, s["out"], out, None if out is None else s["out"] - out, None if fin is None else fin == "length",
                   None if s["fin"] is None else s["fin"] == "length", s["last"] + 1, s["last"], s["closed"])
            names = [*keys, "text", "initial_round_text", "prompt_tokens", "output_tokens", "initial_round_output_tokens", "continuation_output_tokens",
                     "was_truncated", "still_truncated", "num_rounds", "last_round", "is_closed"]
            yield pd.DataFrame([row], columns=names, dtype=object)
        if s["closed"]:  # rounds behind the last one count for nothing; only their numbers stay, so that none comes twice
            s.update(text="", first=None, early={n: None for n in s["early"]})
        state.update((json.dumps(s),))
    return fold


def start_round_stream(rounds: DataFrame, out_dir: str, checkpoint: str, max_continuation_rounds, keys=ROUND_KEYS, compact_every: int = COMPACT_EVERY):
    """Start the stream over ``rounds`` (the keys, round, text, prompt_tokens, output_tokens, finish_reason).

    Rounds above ``max_continuation_rounds`` (an int or a column of ``rounds``) and behind the first one that did not end in ``length`` are dropped.
    A round that comes before the ones below it waits in the state. A round that comes twice stops the stream with an error.
    """
    most = F.lit(max_continuation_rounds) if isinstance(max_continuation_rounds, int) else F.col(max_continuation_rounds)
    rows = rounds.select(*keys, "round", "text", "prompt_tokens", "output_tokens", "finish_reason", most.cast("int").alias("max_rounds")).where("round <= max_rounds")
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    folded = rows.groupBy(*keys).applyInPandasWithState(_folder(tuple(keys)), f"{named}, {_ROW}", "state string", "update", "NoTimeout")
    return write_changes(folded, out_dir, checkpoint, latest(keys), compact_every=compact_every)


def read_folded_rounds(spark: SparkSession, out_dir: str, keys=ROUND_KEYS) -> DataFrame:
    """One row per question whose round 0 has landed: the columns of ``evaluate.fold_rounds``, and ``is_closed``."""
    return landed(spark, out_dir, latest(keys))


def read_open_questions(spark: SparkSession, out_dir: str, keys=ROUND_KEYS) -> DataFrame:
    """The folded rows that wait for another round, for ``evaluate.continuation_worklist``."""
    return read_folded_rounds(spark, out_dir, keys).where(~F.col("is_closed")).drop("is_closed")
