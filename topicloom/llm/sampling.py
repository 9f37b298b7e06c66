"""Problem 5: a uniform sample of fixed size from pages that arrive in pieces of unknown size."""

from __future__ import annotations

import bisect
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import cut

PAGE_SCHEMA = "id STRING, title STRING, tokens ARRAY<STRING>"


#: Rows of a row group, the block of a draw. Small ones make many blocks, and a drawn page costs the reading of one.
BLOCK_ROWS = 1_000


def eligible_pages(stream: DataFrame, min_tokens: int = 5) -> DataFrame:
    """One row per distinct eligible page: page_id, and piece_id and line_no of its first eligible delivery.

    A delivery is eligible if row_json is one valid JSON object whose tokens hold at least min_tokens
    entries that are not blank. The stated token_count is not trusted. A null page_id is replaced by
    the id inside the JSON; a row with neither is no page. First is by piece_id, then line_no (nulls
    last), whenever the piece arrived. Deliveries fold on the map side, so a page that makes up a
    third of the stream is no hot key, and texts are not shuffled.
    """
    rows = _eligible_deliveries(stream, min_tokens)
    return rows.groupBy("page_id").agg(F.min(F.struct("piece_id", "line_no")).alias("_first")).select("page_id", "_first.*")


def _eligible_deliveries(stream: DataFrame, min_tokens: int) -> DataFrame:
    """(page_id, piece_id, line_no, row_json) of every eligible delivery; null piece and line numbers stand last."""
    parsed = F.from_json("row_json", PAGE_SCHEMA)
    tokens = F.filter(F.col("_page.tokens"), lambda t: F.trim(t) != "")
    whole = F.col("row_json").rlike(r"^\s*\{[\s\S]*\}\s*$")
    last = F.lit(2**31 - 1)
    return (
        stream.select("piece_id", "line_no", "row_json", F.col("page_id").alias("_given"), parsed.alias("_page"))
        .where(whole & (F.size(tokens) >= min_tokens))
        .select(F.coalesce("_given", "_page.id").alias("page_id"), F.coalesce("piece_id", last).alias("piece_id"), F.coalesce("line_no", last).alias("line_no"), "row_json")
        .where(F.col("page_id").isNotNull())
    )


def _files(pages: DataFrame) -> list[tuple[str, int, int]]:
    """(file, row groups, rows of its largest one) of every file of a written table, from the footers, which executors read.

    One record per file comes to the driver, as the listing of the table does, none per row group.
    """
    names = pages.inputFiles()
    if not names:
        return []

    def footers(batches):
        import pandas as pd

        for pdf in batches:
            sizes = [_group_sizes(name) for name in pdf["file"]]
            yield pd.DataFrame({"file": pdf["file"], "groups": [len(x) for x in sizes], "largest": [max(x, default=0) for x in sizes]})

    found = pages.sparkSession.createDataFrame([(f,) for f in names], "file STRING").repartition(min(len(names), 256))
    rows = found.mapInPandas(footers, "file STRING, groups INT, largest LONG").where("groups > 0").collect()
    return sorted((r["file"], r["groups"], r["largest"]) for r in rows)


def _group_sizes(name: str) -> list[int]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, inner = fs.FileSystem.from_uri(name)
    with system.open_input_file(inner) as handle:
        meta = pq.ParquetFile(handle).metadata
    return [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]


def draw_slots(blocks: int, largest: int, k: int, seed: int, sizes) -> list[tuple[int, int]]:
    """k distinct (block, offset) pairs, each row of the blocks equally likely, by acceptance and rejection.

    A block is drawn uniformly and an offset below the size of the largest block; an offset that the
    block does not have, or a pair that was drawn before, is rejected. sizes gives the sizes of the
    blocks it is asked for, so only drawn ones are ever looked at. Draws are made in rounds of as many
    as should complete the sample. All rows if there are no more than k of them.
    """
    rng, known, taken, slots = random.Random(seed), {}, set(), []
    idle = 0
    while len(slots) < k and blocks and largest:
        pairs = [(rng.randrange(blocks), rng.randrange(largest)) for _ in range(2 * (k - len(slots)) + 16)]
        if missing := sorted({b for b, _ in pairs} - known.keys()):
            known.update(sizes(missing))
        before = len(slots)
        for pair in pairs:
            if len(slots) < k and pair[1] < known[pair[0]] and pair not in taken:
                taken.add(pair)
                slots.append(pair)
        idle = idle + 1 if len(slots) == before else 0
        if idle >= 3 or blocks * largest <= 4 * k:  # few rows: all of them may be wanted
            if missing := [b for b in range(blocks) if b not in known] if blocks <= 4 * k else []:
                known.update(sizes(missing))
            if len(known) == blocks and sum(known.values()) <= k:
                return [(b, o) for b in range(blocks) for o in range(known[b])]
            idle = 0
    return slots


def reservoir_sample(stream: DataFrame, k: int = 64, min_tokens: int = 5, seed: int = 5) -> DataFrame:
    """(slot, eligible_index, row_json): k of the distinct eligible pages, each equally likely.

    The places of the distinct eligible pages are written once as a table of small row groups, the
    blocks of an acceptance-rejection draw. The driver knows how many row groups each file has and how
    large the largest is, draws blocks and offsets, and has the sizes of drawn blocks looked up; only
    drawn blocks are read again, and one more scan of the stream fetches the texts of the k places.
    eligible_index counts the distinct eligible pages from 1 in the order of their first eligible
    delivery; slot counts the draws from 0. With fewer than k eligible pages all of them come out, with
    none an empty table.
    """
    spark = stream.sparkSession
    pages = cut(eligible_pages(stream, min_tokens), "eligible", **{"parquet.block.row.count.limit": str(BLOCK_ROWS)})
    files = _files(pages)
    empty = spark.createDataFrame([], "slot INT, eligible_index LONG, row_json STRING")
    if not files:
        return empty
    ends = [0]
    for _, groups, _ in files:
        ends.append(ends[-1] + groups)

    def place(block: int) -> tuple[str, int]:
        at = bisect.bisect_right(ends, block) - 1
        return files[at][0], block - ends[at]

    def by_file(df: DataFrame) -> DataFrame:
        """One task for every file named, up to 64: a file's footer is read once."""
        return df.repartition(min(df.select("file").distinct().count(), 64), "file") if len(files) > 1 else df.coalesce(1)

    def sizes(blocks: list[int]) -> dict[int, int]:
        """The sizes of some blocks, a few per slot of the sample, from the footers of their files."""
        import pandas as pd

        asked = spark.createDataFrame(pd.DataFrame([(b, *place(b)) for b in blocks], columns=["block", "file", "row_group"]))

        def look(batches):
            for pdf in batches:
                for name, part in pdf.groupby("file"):
                    found = _group_sizes(name)
                    yield pd.DataFrame({"block": part["block"], "n": [found[g] for g in part["row_group"]]})

        return {r["block"]: r["n"] for r in by_file(asked).mapInPandas(look, "block LONG, n LONG").collect()}

    wanted: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for slot, (block, offset) in enumerate(draw_slots(ends[-1], max(f[2] for f in files), k, seed, sizes)):
        wanted.setdefault(place(block), []).append((offset, slot))
    if not wanted:
        return empty

    def fetch(batches):
        import pyarrow as pa
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for pdf in batches:
            for name, rows in pdf.groupby("file"):
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_file(inner) as handle:
                    table = pq.ParquetFile(handle)
                    for row in rows.itertuples(index=False):
                        part = table.read_row_group(row.row_group, columns=["page_id", "piece_id", "line_no"])
                        picked = part.take(pa.array(list(row.offsets))).to_pandas()
                        picked.insert(0, "slot", list(row.slots))
                        yield picked

    tasks = [(f, g, [o for o, _ in v], [s for _, s in v]) for (f, g), v in sorted(wanted.items())]
    drawn = spark.createDataFrame(tasks, "file STRING, row_group INT, offsets ARRAY<INT>, slots ARRAY<INT>")
    sample = by_file(drawn).mapInPandas(fetch, "slot INT, page_id STRING, piece_id INT, line_no INT")
    places = sorted(((r["piece_id"], r["line_no"], r["page_id"], r["slot"]) for r in sample.collect()))  # at most k
    counts = _counts_before(pages, places)
    index, seen = [], 0
    for i, (piece, line, page, slot) in enumerate(places):
        seen += counts.get(i, 0)
        index.append((piece, line, page, slot, seen))
    chosen = F.broadcast(spark.createDataFrame(index, "piece_id INT, line_no INT, page_id STRING, slot INT, eligible_index LONG"))  # at most k rows; only their lines are parsed again
    last = F.lit(2**31 - 1)
    near = stream.join(chosen.select(F.col("piece_id").alias("_p"), F.col("line_no").alias("_n")).distinct(), (F.coalesce("piece_id", last) == F.col("_p")) & (F.coalesce("line_no", last) == F.col("_n")), "left_semi")
    near = cut(near, "drawn")  # a few rows: written, so that no text is parsed before the join
    texts = _eligible_deliveries(near, min_tokens).join(chosen, ["piece_id", "line_no", "page_id"])
    return texts.groupBy("slot", "eligible_index").agg(F.min("row_json").alias("row_json"))  # a line that came twice counts once


def _counts_before(pages: DataFrame, places: list[tuple]) -> dict[int, int]:
    """How many pages lie between neighbouring ones of at most k sorted places: number of places before them -> pages, from one pass."""
    steps = F.array(*[F.struct(F.lit(p).cast("int"), F.lit(n).cast("int"), F.lit(i)) for p, n, i, _ in places])
    here = F.struct(F.col("piece_id"), F.col("line_no"), F.col("page_id"))
    before = F.size(F.filter(steps, lambda s: s < here))
    return {r["_b"]: r["n"] for r in pages.groupBy(before.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most k + 1
