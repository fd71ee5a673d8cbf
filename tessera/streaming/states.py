"""Stateful operators over streams of trees: an index that takes places back, and intervals of presence.

State is a row a key and a few numbers for each place of the key, so it grows with
what the tree holds now, not with its history.  Results follow units, not arrival:
a version of a file that is older than the one known is left out, and presence that
comes late is merged while its interval is not yet closed.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "value string, file string, module string, line int, unit long, present boolean"
INDEX = "value string, places int, modules int, first_file string, first_line int"
INTERVALS = "a string, b string, opened long, closed long, units long"
DAY_MS = 86_400_000


def literal_changes(versions: DataFrame) -> DataFrame:
    """What each version of a file changes in the index: (value, file, module, line, unit, present), gone places before new ones.

    versions: unit, file, module, deleted, literals array<struct<value, line>>.
    Of a value that a file holds twice, the first line counts; a file that has
    changed its module gives its places back and takes them again; a version that
    changes nothing gives nothing.  Nulls count as no literals.
    """

    def run(key, batches, state: GroupState):
        (file,) = key
        was = json.loads(state.get[0]) if state.exists else {"unit": -1, "module": None, "values": {}}
        rows = pd.concat(list(batches)).sort_values("unit", kind="stable")
        out = []
        for unit, module, deleted, literals in zip(rows["unit"], rows["module"], rows["deleted"], rows["literals"]):
            if unit <= was["unit"]:
                continue
            now: dict[str, int] = {}
            if not deleted and literals is not None:
                for x in sorted(literals, key=lambda x: x["line"]):
                    now.setdefault(x["value"], int(x["line"]))
            same = module == was["module"]
            out += [(v, file, was["module"], n, unit, False) for v, n in was["values"].items() if not same or now.get(v) != n]
            out += [(v, file, module, n, unit, True) for v, n in now.items() if not same or was["values"].get(v) != n]
            was = {"unit": int(unit), "module": module, "values": now}
        state.update((json.dumps(was),))
        yield pd.DataFrame(out, columns=["value", "file", "module", "line", "unit", "present"])

    rows = versions.select("unit", "file", "module", F.coalesce("deleted", F.lit(False)).alias("deleted"), "literals")
    return rows.groupBy("file").applyInPandasWithState(run, CHANGES, "known string", "append", GroupStateTimeout.NoTimeout)


def literal_places(changes: DataFrame) -> DataFrame:
    """(value, places, modules, first_file, first_line) of each value that changes, as it stands after the batch; places 0: held no more.

    changes: as literal_changes gives them, as a stream of their own (update mode).
    """

    def run(key, batches, state: GroupState):
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["unit", "present"], kind="stable")
        for file, module, line, present in zip(rows["file"], rows["module"], rows["line"], rows["present"]):
            if present:
                held[file] = [module, int(line)]
            else:
                held.pop(file, None)
        first = min(held, default=None)
        if held:
            state.update((json.dumps(held),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], len(held), len({m for m, _ in held.values()}), first, held[first][1] if first is not None else None)], columns=["value", "places", "modules", "first_file", "first_line"]).astype({"first_line": "Int32"})

    return changes.groupBy("value").applyInPandasWithState(run, INDEX, "held string", "update", GroupStateTimeout.NoTimeout)


def presence(pairs: DataFrame, at: str = "ts", late: str = "2 days") -> DataFrame:
    """(a, b, opened, closed, units) of each run of days on which a pair is there, once it can grow no more.

    pairs: a, b and the time ``at``.  Days are numbers since 1970.  A run closes
    when the watermark, ``late`` behind the newest time, has passed the day after
    its last: a timer of its key then emits it, and runs of a key come in order.
    """

    def run(key, batches, state: GroupState):
        days = set(json.loads(state.get[0])) if state.exists else set()
        for b in batches:
            days |= {int(d) for d in b["day"]}
        mark = state.getCurrentWatermarkMs() // DAY_MS
        runs: list[list[int]] = []
        for d in sorted(days):
            if runs and d == runs[-1][1] + 1:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        done = [r for r in runs if r[1] + 1 < mark]
        open_ = [r for r in runs if r[1] + 1 >= mark]
        if open_:
            state.update((json.dumps([d for lo, hi in open_ for d in range(lo, hi + 1)]),))
            state.setTimeoutTimestamp((max(open_[0][1] + 2, mark + 1)) * DAY_MS)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, lo, hi, hi - lo + 1) for lo, hi in done], columns=["a", "b", "opened", "closed", "units"])

    rows = pairs.withWatermark(at, late).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), at, F.unix_date(F.col(at).cast("date")).cast("long").alias("day"))
    return rows.groupBy("a", "b").applyInPandasWithState(run, INTERVALS, "days string", "append", GroupStateTimeout.EventTimeTimeout)
