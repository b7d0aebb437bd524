"""One-to-one assignment of a lane's videos to audios, with the choice of none."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.functions.scalars import MIN_LANE_SCORE, NULL_SCORE
from cadenza.operators.graph import components
from cadenza.schemas import ASSIGNMENT


#: Rows that a task gathers before it solves the whole lanes among them, cells of the costs that it solves side by side, and pairs that it makes of clips at a time.
ROWS, CELLS, PAIRS = 100_000, 2_000_000, 1_000_000


def best_columns(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a one-to-one assignment of least total cost; rows not more than columns."""
    return _best_columns(cost[None], np.array([len(cost)]))[0]


def _best_columns(cost: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """best_columns of many grids side by side, (grid, row, column): only the first ``rows`` of each count, and columns without end are never taken.

    Rows enter one at a time along a shortest augmenting path over reduced costs.
    """
    grids, most, cols = cost.shape
    u, v = np.zeros((grids, most)), np.zeros((grids, cols))
    row_of = np.full((grids, cols), -1)
    for row in range(most):
        own = np.flatnonzero(rows > row)
        shortest, came, done = np.full((len(own), cols), np.inf), np.full((len(own), cols), -1), np.zeros((len(own), cols), bool)
        i, low, j_from, j = np.full(len(own), row), np.zeros(len(own)), np.full(len(own), -1), np.zeros(len(own), int)
        on = np.arange(len(own))  # whose path goes on
        while len(on):
            at = own[on]
            reach = low[on, None] + cost[at, i[on]] - u[at, i[on]][:, None] - v[at]
            better = ~done[on] & (reach < shortest[on] - 1e-12)
            shortest[on], came[on] = np.where(better, reach, shortest[on]), np.where(better, j_from[on, None], came[on])
            open_cost = np.where(done[on], np.inf, shortest[on])
            to = open_cost.argmin(axis=1)
            j[on], low[on], done[on, to] = to, open_cost[np.arange(len(on)), to], True
            held = row_of[at, to]
            more = held >= 0
            on = on[more]
            i[on], j_from[on] = held[more], to[more]
        g, seen = np.nonzero(done & (row_of[own] >= 0))
        u[own, row] += low
        u[own[g], row_of[own[g], seen]] += low[g] - shortest[g, seen]
        v[own] += np.where(done, shortest - low[:, None], 0)
        on = np.arange(len(own))
        while len(on):
            before = came[on, j[on]]
            row_of[own[on], j[on]] = np.where(before >= 0, row_of[own[on], before], row)
            j[on] = before
            on = on[before >= 0]
    out = np.full((grids, most), -1)
    g, used = np.nonzero(row_of >= 0)
    out[g, row_of[g, used]] = used
    return out


def _nodes(lane: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's (lane, name) among the distinct ones in order, and a row of each."""
    order = np.lexsort((name, lane))
    turn = np.ones(len(order), bool)
    turn[1:] = (lane[order][1:] != lane[order][:-1]) | (name[order][1:] != name[order][:-1])
    node = np.empty(len(order), int)
    node[order] = np.cumsum(turn) - 1
    return node, order[turn]


def _parts(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of n nodes that each hangs together with by edges (left, right)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, left, low[right])
        np.minimum.at(low, right, low[left])
        low = low[low]
        if np.array_equal(low, before):
            return low


def assign_lane(video: np.ndarray, audio: np.ndarray, score: np.ndarray) -> list[tuple]:
    """(video, audio or None, pair_score, assigned, cost) of each video of one lane's pairs; ties go by video and audio."""
    at, with_, value, good, cost = assign_lanes(np.zeros(len(video), int), video, audio, score)
    return [(video[a], audio[w] if w >= 0 else None, float(x), bool(g), float(c)) for a, w, x, g, c in zip(at, with_, value, good, cost, strict=True)]


def assign_lanes(lane: np.ndarray, video: np.ndarray, audio: np.ndarray, score: np.ndarray, sets: int = 0) -> tuple[np.ndarray, ...]:
    """(row of the video, row of its audio or -1, pair_score, assigned, cost) of each video of each lane's pairs.

    A pair below the null choice is never taken, so videos and audios fall into parts that
    only pairs at least as good join. Where no two videos of a part have the same best audio
    each takes its own; other parts are solved, those of like sizes side by side. A negative
    audio stands for no pair, with the best score that a video's other pairs have. Lanes of
    up to ``sets`` audios are gone through video by video and set by set of audios used: of
    choices that cost the same but for rounding, that of the least sum in this order wins.
    """
    (v, at), (a, audio_at) = _nodes(lane, video), _nodes(lane, audio)
    best = np.zeros(len(at))
    np.maximum.at(best, v, score)
    value = best.copy()
    strong = np.flatnonzero((score >= NULL_SCORE) & (audio >= 0))
    v, a, score = v[strong], a[strong], score[strong]
    part = _parts(len(at) + len(audio_at), v, a + len(at))[: len(at)]
    order = np.lexsort((a, -score, v))
    first = order[np.append(True, v[order][1:] != v[order][:-1])] if len(order) else order
    taken = np.full(len(at), -1)
    uses = np.bincount(a[first], minlength=len(audio_at))
    shared = np.zeros(len(at), bool)
    shared[part[v[first][uses[a[first]] > 1]]] = True
    first = first[~shared[part[v[first]]]]
    taken[v[first]], value[v[first]] = a[first], score[first]
    own = shared[part[v]]
    if sets and own.any():
        whole, named = _nodes(lane[at][v], a)
        _, first_of, of = np.unique(lane[at][v][named], return_index=True, return_inverse=True)
        bit = np.arange(len(named)) - first_of[of]
        few = (np.bincount(of)[of] <= sets)[whole]
        hard = np.isin(lane[at], lane[at][v[own & few]])
        taken[hard], value[hard] = -1, best[hard]
        _solve_sets(lane[at], np.flatnonzero(hard), v[hard[v]], a[hard[v]], bit[whole][hard[v]], score[hard[v]], taken, value)
        own &= ~hard[v]
    own = np.flatnonzero(own)
    if len(own):
        _solve_parts(part[v[own]], v[own], a[own], score[own], taken, value)
    good = (taken >= 0) & (value >= MIN_LANE_SCORE)
    cost = 1 - np.where(taken >= 0, value, NULL_SCORE)
    return at, np.where(good, audio_at[taken], -1), value, good, cost


def _solve_parts(part: np.ndarray, v: np.ndarray, a: np.ndarray, score: np.ndarray, taken: np.ndarray, value: np.ndarray) -> None:
    """Fill in the audio that each video of the parts takes, if any, and its score."""
    _, p = np.unique(part, return_inverse=True)
    (r, row_at), (c, col_at) = _nodes(p, v), _nodes(p, a)
    rows, cols = np.bincount(p[row_at]), np.bincount(p[col_at])
    row_from, col_from = np.cumsum(rows) - rows, np.cumsum(cols) - cols
    kind = np.ceil(np.log2(rows)).astype(int) * 64 + np.ceil(np.log2(cols)).astype(int)
    order = np.argsort(p, kind="stable")
    begin, size = np.searchsorted(p[order], np.arange(len(rows))), np.bincount(p)
    for k in np.unique(kind):
        alike = np.flatnonzero(kind == k)
        n, m = rows[alike].max(), cols[alike].max()
        step = max(1, CELLS // int(n * (n + m)))
        for some in (alike[x : x + step] for x in range(0, len(alike), step)):
            edges = order[np.repeat(begin[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())]
            g = np.repeat(np.arange(len(some)), size[some])
            grid = np.zeros((len(some), n, m))
            np.maximum.at(grid, (g, r[edges] - row_from[p[edges]], c[edges] - col_from[p[edges]]), score[edges])
            cost = np.concatenate((1 - grid, np.full((len(some), n, n), 2.0)), axis=2)
            cost[:, np.arange(n), m + np.arange(n)] = 1 - NULL_SCORE
            here = np.concatenate((np.arange(m) < cols[some][:, None], np.arange(n) < rows[some][:, None]), axis=1)
            cost = np.where(here[:, None, :], cost, np.inf)
            column = _best_columns(cost, rows[some])
            g, i = np.nonzero((column >= 0) & (column < m))
            col, who = column[g, i], v[row_at[row_from[some[g]] + i]]
            taken[who], value[who] = a[col_at[col_from[some[g]] + col]], grid[g, i, col]


def _solve_sets(lane: np.ndarray, videos: np.ndarray, v: np.ndarray, a: np.ndarray, bit: np.ndarray, score: np.ndarray, taken: np.ndarray, value: np.ndarray) -> None:
    """Fill in what the videos of whole lanes take, by the least sum for each set of audios used so far; v, a, bit and score are their pairs.

    Of equal sums the last audio wins, and any before none.
    """
    _, start, place = np.unique(lane[videos], return_index=True, return_inverse=True)
    size, turn = np.bincount(place), np.arange(len(videos)) - start[place]
    row = np.full(len(lane), -1)
    row[videos] = np.arange(len(videos))
    bits, at_row = int(bit.max()) + 1, row[v]
    order = np.argsort(size, kind="stable")
    step = np.maximum(1, CELLS // (size[order] << bits))
    k = 0
    while k < len(order):
        n = int(size[order[min(len(order), k + int(step[k])) - 1]])
        some = order[k : k + max(1, CELLS // (n << bits))]
        n, k = int(size[some].max()), k + len(some)
        seat = np.full(len(size), -1)
        seat[some] = np.arange(len(some))
        mine = np.flatnonzero(seat[place[at_row]] >= 0)
        grid, audio = np.zeros((len(some), n, bits)), np.full((len(some), n, bits), -1)
        index = seat[place[at_row[mine]]], turn[at_row[mine]], bit[mine]
        np.maximum.at(grid, index, score[mine])
        audio[index] = a[mine]
        price = np.where(audio >= 0, 1 - grid, np.inf)
        total = np.full((len(some), 1 << bits), np.inf)
        total[:, 0] = 0
        chosen = np.full((len(some), n, 1 << bits), -1, np.int8)
        every = np.arange(1 << bits)
        for i in range(n):
            on = np.flatnonzero(size[some] > i)
            before, after = total[on], np.full((len(on), 1 << bits), np.inf)
            pick = np.full((len(on), 1 << bits), -1, np.int8)
            for b in (*range(bits - 1, -1, -1), -1):
                into = every[every >> b & 1 == 1] if b >= 0 else every
                sums = before[:, into ^ (1 << b)] + price[on, i, b, None] if b >= 0 else before + (1 - NULL_SCORE)
                less = sums < after[:, into]
                after[:, into] = np.where(less, sums, after[:, into])
                pick[:, into] = np.where(less, b, pick[:, into])
            total[on], chosen[on, i] = after, pick
        used = total.argmin(axis=1)
        for i in range(n - 1, -1, -1):
            on = np.flatnonzero(size[some] > i)
            b = chosen[on, i, used[on]].astype(int)
            on, b = on[b >= 0], b[b >= 0]
            used[on] ^= 1 << b
            who = videos[start[some[on]] + i]
            taken[who], value[who] = audio[on, i, b], grid[on, i, b]


def _ranks(names: pa.Array) -> np.ndarray:
    """The place of each name among the distinct ones in order."""
    coded = names.dictionary_encode()  # null has no code
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return np.append(rank, -1)[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def _turns(rows: pa.Table, groups: list[str]) -> np.ndarray:
    """Where a row is of another group than the one before."""
    turn = np.zeros(len(rows), bool)
    turn[:1] = True
    for c in groups:
        code = rows.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        turn[1:] |= code[1:] != code[:-1]
    return turn


def _solved(rows: pa.Table, turn: np.ndarray, keys: list[str], sets: int) -> pa.RecordBatch:
    """ASSIGNMENT rows of whole lanes that begin where turn says."""
    video, audio = (_ranks(rows.column(c).combine_chunks()) for c in ("video", "audio"))
    at, with_, value, good, cost = assign_lanes(np.cumsum(turn), video, audio, rows.column("pair_score").to_numpy(), sets)
    lanes = rows.select([*keys, "video"]).take(pa.array(at, pa.int64()))
    audios = rows.column("audio").combine_chunks().take(pa.array(with_, pa.int64(), mask=with_ < 0))
    columns = [*(lanes.column(c).combine_chunks() for c in (*keys, "video")), audios, pa.array(value, pa.float64()), pa.array(good, pa.bool_()), pa.array(cost, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "video", "audio", "pair_score", "assigned", "cost"])


def _whole(groups: list[str], solve: Callable[[pa.Table, np.ndarray], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What solve makes of sorted rows, ROWS or more of whole groups at a time, and of where they turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < least:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            turn = _turns(rows, groups)
            last = int(np.flatnonzero(turn)[-1])  # it may go on
            if last:
                yield from solve(rows.slice(0, last), turn[:last])
            held, n = rows.slice(last).to_batches(), n - last
            least = max(ROWS, 2 * n)
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from solve(rows, _turns(rows, groups))

    return run


def _split(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with part: what hangs together by pairs that beat the null choice; other rows have their video's, or one of their own."""
    node = lambda c: F.struct(*keys, F.lit(c).alias("side"), F.col(c).cast("string").alias("name"))
    strong = pairs.where((F.col("pair_score") >= NULL_SCORE) & F.col("audio").isNotNull())
    found = components(strong.select(node("video").alias("a"), node("audio").alias("b")))
    rows = pairs.withColumn("node", node("video")).join(found, "node", "left")
    return rows.withColumn("part", F.xxhash64(F.coalesce("component", "node"))).drop("node", "component")


def assign(pairs: DataFrame, *within: str, large: bool = False, costs: bool = False, sets: int = 0) -> DataFrame:
    """ASSIGNMENT rows, with ``within`` before them, from pairs (*within, lane, video, audio, pair_score); with costs also what each choice costs.

    A row without an audio keeps a video that no pair is given of, with the best score of
    those left out. Lanes are solved in memory, side by side, part by part of what pairs
    above the null choice join, many lanes at once; names stay in Arrow, the solver sees numbers. With large,
    lanes are split into those parts over Spark tables first, so that a task holds the
    pairs of a part and not of a lane. Lanes of up to ``sets`` audios are solved as
    assign_lanes says, so that ties go as in SQL over sets of audios.
    """
    keys = [*within, "lane"]
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (*within, "lane", "video", "audio")}
    head = "".join(f"`{c}` {kinds[c]}, " for c in within)
    schema = head + ASSIGNMENT.replace("lane int", f"lane {kinds['lane']}").replace("video string", f"video {kinds['video']}").replace("audio string", f"audio {kinds['audio']}")
    schema += ", cost double"
    rows = pairs.select(*keys, "video", "audio", "pair_score")
    groups = [*keys, "part"] if large else keys
    rows = _split(rows, keys) if large else rows

    run = _whole(groups, lambda rows, turn: [_solved(rows, turn, keys, sets)])
    return rows.repartition(*groups).sortWithinPartitions(*groups, "video").mapInArrow(run, schema).drop(*(() if costs else ("cost",)))


def near_scores(audio_s: np.ndarray, video_s: np.ndarray, waveform: float) -> np.ndarray:
    """scalars.pair_score of scalars.duration_score, by the same operations."""
    delta = audio_s - video_s
    gap = np.abs(delta)
    overflow = np.where(delta > S.LATE_SECONDS, delta - S.LATE_SECONDS, gap - S.EARLY_SECONDS)
    near = np.where((delta >= -S.EARLY_SECONDS) & (delta <= S.LATE_SECONDS), 1 - np.minimum(gap / 120, 0.35), np.maximum(0.0, 0.65 - overflow / 120))
    return np.maximum(0.0, np.minimum(1.0, 0.65 * np.where(gap > S.MAX_GAP_SECONDS, 0.0, near) + 0.35 * waveform))


def _lanes_of(rows: pa.Table, keys: list[str], waveform: float) -> Iterator[pa.RecordBatch]:
    """ASSIGNMENT rows of whole sessions, their audios before their videos; lanes are solved PAIRS pairs at a time, or one by one."""
    session = np.cumsum(_turns(rows, keys[:-1])) - 1
    sounds = rows.column("side").to_numpy() == 0
    seconds = rows.column("seconds").to_numpy(zero_copy_only=False)
    bucket = np.floor(seconds / S.MAX_GAP_SECONDS)
    bucket[~np.isfinite(bucket)] = 0  # of no length: near nothing
    _, bucket = np.unique(np.concatenate((bucket, bucket - 1, bucket + 1)), return_inverse=True)
    here, below, above = bucket.reshape(3, -1) + session * (int(bucket.max(initial=0)) + 1)
    audios, videos = np.flatnonzero(sounds), np.flatnonzero(~sounds)
    first = np.searchsorted(session[audios], np.arange(session[-1] + 2))
    least, most = np.full(session[-1] + 1, np.inf), np.full(session[-1] + 1, -np.inf)
    np.fmin.at(least, session[audios], seconds[audios])
    np.fmax.at(most, session[audios], seconds[audios])
    videos = videos[(np.diff(first) > 0)[session[videos]]]  # a session without audios has no pairs
    if not len(videos):
        return
    far = (seconds[videos] - least[session[videos]] > S.MAX_GAP_SECONDS) | (most[session[videos]] - seconds[videos] > S.MAX_GAP_SECONDS)
    far = np.where(far, max(0.0, min(1.0, 0.65 * 0.0 + 0.35 * waveform)), 0.0)
    audios = audios[np.argsort(here[audios], kind="stable")]
    begin = np.searchsorted(here[audios], below[videos], "left")
    n = np.searchsorted(here[audios], above[videos], "right") - begin
    lane = np.cumsum(_turns(rows, keys))[videos]
    starts = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
    part = np.cumsum(np.add.reduceat(n, starts)) // PAIRS
    cuts = [*starts[np.append(True, part[1:] != part[:-1])].tolist(), len(videos)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        own, size = videos[x:y], n[x:y]
        v = np.repeat(np.arange(x, y), size)
        a = audios[np.repeat(begin[x:y] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        met = np.abs(seconds[a] - seconds[videos[v]]) <= S.MAX_GAP_SECONDS
        v, a = v[met], a[met]
        score = near_scores(seconds[a], seconds[videos[v]], waveform)
        everyone, row = np.concatenate((np.arange(x, y), v)), np.concatenate((np.full(y - x, -1), a))
        sound, code = np.unique(a, return_inverse=True)
        video, audio = _ranks(rows.column("video").take(pa.array(own)).combine_chunks()), _ranks(rows.column("audio").take(pa.array(sound)).combine_chunks())
        with_ = np.concatenate((np.full(y - x, -1), audio[code]))
        at, taken, value, good, cost = assign_lanes(lane[everyone], video[everyone - x], with_, np.concatenate((far[x:y], score)))
        told = rows.select([*keys, "video"]).take(pa.array(videos[everyone[at]]))
        audio = rows.column("audio").combine_chunks().take(pa.array(row[taken], pa.int64(), mask=taken < 0))
        columns = [*(told.column(c).combine_chunks() for c in (*keys, "video")), audio, pa.array(value, pa.float64()), pa.array(good, pa.bool_()), pa.array(cost, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "video", "audio", "pair_score", "assigned", "cost"])


def assign_near(audio: DataFrame, video: DataFrame, waveform: float, *within: str, costs: bool = False) -> DataFrame:
    """assign of the pairs of near_pairs and far_scores, all of one waveform score; inputs (*within, audio, audio_s) and (*within, lane, video, video_s).

    Audios and videos are dealt by session and meet in tasks, by buckets of their lengths,
    so that clips are shipped and not pairs. A task holds a session's clips, and of its
    pairs those of one lane, or PAIRS of several.
    """
    keys = [*within, "lane"]
    kinds = {c: d.schema[c].dataType.simpleString() for d, cs in ((video, [*keys, "video"]), (audio, ["audio"])) for c in cs}
    blank = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = audio.select(*within, blank("lane"), F.lit(0).alias("side"), blank("video"), "audio", F.col("audio_s").cast("double").alias("seconds")).unionByName(
        video.select(*keys, F.lit(1).alias("side"), "video", blank("audio"), F.col("video_s").cast("double").alias("seconds"))
    )
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "video", "audio")) + ", pair_score double, assigned boolean, cost double"
    run = _whole(list(within), lambda rows, _: _lanes_of(rows, keys, waveform))
    return rows.repartition(*within).sortWithinPartitions(*within, "side", "lane").mapInArrow(run, schema).drop(*(() if costs else ("cost",)))


def lane_costs(rows: DataFrame, *within: str) -> DataFrame:
    """(*within, lane, videos, cost): what the assignment of each lane costs in all, 1 - NULL_SCORE for a video left to the null choice; rows are assigned ones with costs."""
    return rows.groupBy(*within, "lane").agg(F.count(F.lit(1)).alias("videos"), F.sum("cost").alias("cost"))
