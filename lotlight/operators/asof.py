"""As-of joins: what a history showed strictly before each of many dates.

No join compares dates: events and questions of a key are merged into one
order of dates, and a running total up to a question is its answer.  Events
are added up by day before, so a key has at most two rows a day in its window,
however many events it has.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions that one task of ``most_before`` takes.
SLICE = 1_000_000


def counts_before(events: DataFrame, asked: DataFrame, group: str, member: str, date: str = "publish_date") -> DataFrame:
    """events (group, member, date); asked (group, as_of).  For each asked
    group and date, every member with earlier events and their number:
    (group, as_of, member, n).

    Null dates are never earlier; repeated questions count once."""
    daily = events.filter(F.col(date).isNotNull()).groupBy(group, member, F.col(date).alias("_at")).agg(F.count("*").alias("_n"))
    members = daily.groupBy(group, member).agg(F.min("_at").alias("_first"))
    wanted = asked.select(group, "as_of").distinct().join(members, group).filter(F.col("_first") < F.col("as_of"))
    merged = daily.select(group, member, "_at", "_n", F.lit(False).alias("_asks")).unionByName(wanted.select(group, member, F.col("as_of").alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asks")))
    # a question comes before the events of its own day
    order = Window.partitionBy(group, member).orderBy("_at", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return merged.withColumn("n", F.sum("_n").over(order)).filter("_asks").select(group, F.col("_at").alias("as_of"), member, "n")


def most_before(events: DataFrame, asked: DataFrame, group: str, member: str, limit: int, blocks: int, slices: int, date: str = "publish_date") -> DataFrame:
    """events (group, member, date); asked (query, group, as_of).  For each
    query the ``limit`` members with most events in its groups before its date,
    ties to the smaller member: (query, member, n).

    Members are dealt into ``blocks``, queries into ``slices``.  A task goes
    through the dates of a block's events with one table of counts by group and
    member, and answers each query from it, so no pair of query and member
    leaves it beyond the best ``limit``.  Give so many blocks that a block has
    some thousand members and a few million events."""
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    held = events.dropna(subset=[group, member, date]).select(deal(member, blocks).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), F.col(group).alias("_group"), F.col(member).alias("_member"), F.col(date).alias("_at"))
    wanted = asked.dropna(subset=[group, "as_of"]).select("query", F.col(group).alias("_group"), "as_of").distinct()
    wanted = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), deal("query", slices).alias("_slice"), "query", "_group", "as_of")
    out = pa.schema([("query", pa.int64()), (member, pa.int64()), ("n", pa.int64())])

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        if not len(own) or not len(told):
            return out.empty_table()
        own, told = own.sort_by("_at"), told.sort_by([("as_of", "ascending"), ("query", "ascending")])
        names = told["_group"].combine_chunks().dictionary_encode()
        groups = names.indices.to_numpy()
        at = pa.compute.index_in(own["_group"], names.dictionary).to_numpy()
        known = ~np.isnan(at)  # groups that nobody asks for are not counted
        if not known.any():
            return out.empty_table()
        members, who = np.unique(own["_member"].to_numpy()[known], return_inverse=True)
        days = own["_at"].cast(pa.int32()).to_numpy()[known]
        cell, width = at[known].astype(np.int64) * len(members) + who, len(members)
        counts = np.zeros(len(names.dictionary) * width, np.int64)
        queries, dates = told["query"].to_numpy(), told["as_of"].cast(pa.int32()).to_numpy()
        starts = np.flatnonzero(np.diff(queries, prepend=queries[0] - 1) | np.diff(dates, prepend=dates[0]))
        upto, seen, found = np.searchsorted(days, dates[starts]), 0, []
        for lo, hi, end in zip(starts, [*starts[1:], len(queries)], upto):
            if end > seen:
                np.add.at(counts, cell[seen:end], 1)
                seen = end
            total = counts.reshape(-1, width)[groups[lo:hi]].sum(axis=0)
            key = total * width + np.arange(width - 1, -1, -1)  # of equal counts the smaller member first
            best = np.argpartition(key, width - limit)[width - limit :] if width > limit else np.arange(width)
            best = best[total[best] > 0]
            found.append((np.full(len(best), queries[lo]), members[best], total[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], schema=out)

    met = held.groupBy("_block", "_slice").cogroup(wanted.groupBy("_block", "_slice")).applyInArrow(run, f"query long, `{member}` long, n long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), member))
    return met.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


#: Members that ``ranks_before`` compares at a time.
WIDTH = 2048


def ranks_before(events: DataFrame, asked: DataFrame, wanted: DataFrame, group: str, member: str, histories: list[str], limit: int, buckets: int, slices: int, date: str = "publish_date") -> DataFrame:
    """events (group, member, date, a boolean column for each of histories);
    asked (query, group, as_of, one date a query); wanted (query, member).  The
    place of each wanted member among all by its number of events in the
    query's groups before its date, ties to the smaller member, where it has
    events and its place is ``limit`` at most: (history, query, member, rank).

    Queries are dealt by their dates into ``slices``.  A group's events become,
    for each slice, one compressed row of the counts at its first date and its
    own events, so a slice takes the history as counts and no pair of query and
    other member is ever a row.  In a task, members lie in ``buckets``, one of
    which is open at a time: first the wanted members' counts are read, then
    members are counted that stand before them, until ``limit`` do.  Give so
    many buckets that one has some thousand members.  Groups meet by a 64-bit hash."""
    deal = F.pmod(F.col(member), F.lit(buckets)).cast("int").alias("_bucket")
    kinds = sum((F.when(F.col(h), 1 << i).otherwise(0) for i, h in enumerate(histories)), F.lit(0)).cast("int")
    held = events.dropna(subset=[group, member, date]).select(deal, F.xxhash64(group).alias("_group"), F.col(member).cast("long").alias("_member"), F.unix_date(date).alias("_day"), kinds.alias("_kinds")).filter("_kinds > 0")
    told = asked.dropna(subset=[group, "as_of"]).groupBy("query").agg(F.unix_date(F.min("as_of")).alias("_day"), F.collect_set(F.xxhash64(group)).alias("_groups"))
    told = told.join(wanted.dropna().groupBy("query").agg(F.collect_set(F.col(member).cast("long")).alias("_members")), "query")
    # as many slices of whole days as have about the same number of queries; days are few
    per = told.groupBy("_day").count().orderBy("_day").collect()
    upto, whole = np.cumsum([0, *(r["count"] for r in per)]), sum(r["count"] for r in per)
    first = {int(n * slices // max(whole, 1)): r["_day"] for r, n in list(zip(per, upto))[::-1]}
    starts = np.array(sorted(first.values()), np.int64)
    told = told.withColumn("_slice", F.size(F.filter(F.lit(starts.tolist()).cast("array<int>"), lambda d: d <= F.col("_day"))) - 1)
    n = len(histories)

    def count(into: np.ndarray, cells: np.ndarray, kinds: np.ndarray) -> None:
        for h in range(n):
            np.add.at(into[h].reshape(-1), cells[kinds >> h & 1 > 0], 1)

    def split(own: pa.Table) -> pa.Table:
        order = np.argsort(own["_day"].to_numpy(), kind="stable")
        days, kind = own["_day"].to_numpy()[order].astype(np.int32), own["_kinds"].to_numpy()[order].astype(np.uint8)
        members, who = np.unique(own["_member"].to_numpy()[order], return_inverse=True)
        who, counts, rows, seen = who.astype(np.int32), np.zeros((n, len(members)), np.int32), [], 0
        for lo, hi in zip(np.searchsorted(days, starts), [*np.searchsorted(days, starts[1:]), len(days)]):
            count(counts, who[seen:lo], kind[seen:lo])
            seen = lo
            planes = lambda a: a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
            plain = pickle.dumps((planes(np.diff(members, prepend=0)), planes(counts.reshape(-1)), planes(who[lo:hi]), planes(days[lo:hi]), kind[lo:hi].tobytes()))
            rows.append((len(plain), pa.compress(plain, "zstd", asbytes=True)))
        k = len(rows)
        same = lambda name: own[name].slice(0, 1).take(pa.array(np.zeros(k, np.int64)))
        return pa.table([pa.array(np.arange(k), pa.int32()), same("_bucket"), same("_group"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["_slice", "_bucket", "_group", "size", "packed"])

    out = pa.schema([("history", pa.int32()), ("query", pa.int64()), (member, pa.int64()), ("rank", pa.int32())])

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        if not len(own) or not len(told):
            return out.empty_table()
        told = told.sort_by("_day").combine_chunks()
        days = told["_day"].to_numpy()
        names, people = told["_groups"].combine_chunks(), told["_members"].combine_chunks()
        held = names.flatten().dictionary_encode()
        groups, from_group = held.indices.to_numpy(), np.cumsum([0, *pa.compute.list_value_length(names).to_numpy()])
        member, from_pair = people.flatten().to_numpy(), np.cumsum([0, *pa.compute.list_value_length(people).to_numpy()])
        known = {g: i for i, g in enumerate(held.dictionary.to_pylist())}
        row_of = np.repeat(np.arange(len(told)), np.diff(from_pair))  # of a pair
        # a pair meets each of its query's groups
        times = np.diff(from_group)[row_of]
        pair = np.repeat(np.arange(len(member)), times)
        at = groups[np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(from_group[row_of], times)]
        from_both = np.cumsum([0, *times])
        opened = np.flatnonzero(np.diff(days, prepend=days[0] - 1))
        spans = list(zip(opened, [*opened[1:], len(days)]))
        wide = lambda raw, kind: np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
        buckets, where = own["_bucket"].to_numpy(), own["_group"].to_pylist()

        def replayed(bucket: int):
            """The bucket's members and counts as they were before each span's day."""
            taken = []
            for i in np.flatnonzero(buckets == bucket):
                if where[i] in known:
                    ids, base, who, on, kind = pickle.loads(pa.decompress(own["packed"][i].as_buffer(), own["size"][i].as_py(), "zstd"))
                    taken.append((known[where[i]], np.cumsum(wide(ids, np.int64)), wide(base, np.int32), wide(who, np.int32), wide(on, np.int32), np.frombuffer(kind, np.uint8)))
            if not taken:
                return
            members = np.unique(np.concatenate([ids for _, ids, *_ in taken]))
            counts, cells = np.zeros((n, len(known), len(members)), np.int32), []
            for g, ids, base, who, _, _ in taken:
                place = np.searchsorted(members, ids)
                counts[:, g, place] = base.reshape(n, -1)
                cells.append(g * len(members) + place[who])
            on = np.concatenate([x[4] for x in taken])
            order = np.argsort(on, kind="stable")
            on, cells, kind = on[order], np.concatenate(cells)[order], np.concatenate([x[5] for x in taken])[order]
            seen = 0
            for lo, hi in spans:
                end = np.searchsorted(on, days[lo])
                count(counts, cells[seen:end], kind[seen:end])
                seen = end
                yield lo, hi, members, counts

        all_buckets = np.unique(buckets)
        own_n, before = np.zeros((n, len(member)), np.int64), np.zeros((n, len(member)), np.int64)
        for b in all_buckets:
            for lo, hi, members, counts in replayed(b):
                p = slice(from_pair[lo], from_pair[hi])
                both = slice(from_both[p.start], from_both[p.stop])
                place = np.searchsorted(members, member[pair[both]])
                place[place == len(members)] = 0
                here = members[place] == member[pair[both]]
                for h in range(n):
                    own_n[h, p] += np.bincount(pair[both][here] - p.start, counts[h, at[both][here], place[here]], minlength=p.stop - p.start).astype(np.int64)
        alive = own_n > 0
        for b in all_buckets:
            for lo, hi, members, counts in replayed(b):
                open_rows = np.unique(row_of[from_pair[lo] : from_pair[hi]][alive[:, from_pair[lo] : from_pair[hi]].any(axis=0)])
                for row in open_rows:
                    mine = groups[from_group[row] : from_group[row + 1]]
                    left = [(h, p) for p in range(from_pair[row], from_pair[row + 1]) for h in range(n) if alive[h, p]]
                    for start in range(0, len(members), WIDTH):
                        total = np.add.reduce(counts[:, mine, start : start + WIDTH], axis=1, dtype=np.int32)
                        for h, p in left:
                            smaller = np.searchsorted(members[start : start + WIDTH], member[p])
                            before[h, p] += np.count_nonzero(total[h] > own_n[h, p]) + np.count_nonzero(total[h, :smaller] == own_n[h, p])
                            alive[h, p] = before[h, p] < limit
                        left = [x for x in left if alive[x]]
                        if not left:
                            break
        h, p = np.nonzero(alive)
        return pa.table([pa.array(h, pa.int32()), pa.array(told["query"].to_numpy()[row_of[p]]), pa.array(member[p]), pa.array(before[h, p] + 1, pa.int32())], schema=out)

    packed = held.groupBy("_bucket", "_group").applyInArrow(split, "_slice int, _bucket int, _group long, size long, packed binary")
    return packed.groupBy("_slice").cogroup(told.groupBy("_slice")).applyInArrow(run, f"history int, query long, `{member}` long, rank int")
