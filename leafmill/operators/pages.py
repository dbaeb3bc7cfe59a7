"""Pages, blocks, rules, outline and title of PDF files, joined from their objects.

objects: file, number, kind (trailer, stream, plain), entries, stream, as the format "pdf" gives them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import pdf

STRUCTURE = "file string, what string, n int, level int, title string, page int, width double, height double, contents array<int>, fonts map<string, int>"
STRUCTURE_KINDS = pa.schema([("file", pa.string()), ("what", pa.string()), ("n", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("contents", pa.list_(pa.int32())), ("fonts", pa.map_(pa.string(), pa.int32()))])
RUN = "file string, page int, seq int, kind string, block int, x0 double, y0 double, x1 double, y1 double, size double, text string"
RUN_KINDS = pa.schema([("file", pa.string()), ("page", pa.int32()), ("seq", pa.int32()), ("kind", pa.string()), ("block", pa.int32()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "size")), ("text", pa.string())])
#: Rows that a task gives on at once, about.
ROWS = 8192


def _batches(rows: Iterator[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)


def _inherited(nodes: dict[int, dict[str, str]], number: int, name: str) -> str:
    """An entry of a page, or of the nearest node above it that has one."""
    seen: set[int] = set()
    while number in nodes and number not in seen:
        if name in nodes[number]:
            return nodes[number][name]
        seen.add(number)
        number = pdf.reference(nodes[number].get("Parent")) or -1
    return ""


def _fonts(nodes: dict[int, dict[str, str]], resources: str) -> dict[str, int]:
    """Name of each font of a page to the object of its map to Unicode."""
    entries = nodes.get(pdf.reference(resources), {}) if pdf.reference(resources) else pdf.fields(resources.encode("latin-1"))[0]
    listed = entries.get("Font", "")
    named = nodes.get(pdf.reference(listed), {}) if pdf.reference(listed) else pdf.fields(listed.encode("latin-1"))[0]
    maps = {n: pdf.reference(nodes.get(pdf.reference(v) or -1, {}).get("ToUnicode")) for n, v in named.items()}
    return {n: m for n, m in maps.items() if m is not None}


def _structure(file: str, nodes: dict[int, dict[str, str]]) -> list[tuple]:
    """A file's pages in order and its outline, from the objects that are no streams."""
    root = nodes.get(pdf.reference(nodes.get(0, {}).get("Root")) or -1, {})
    title = nodes.get(pdf.reference(nodes.get(0, {}).get("Info")) or -1, {}).get("Title")
    out, places, todo, seen = [], {}, [pdf.reference(root.get("Pages"))], set()
    while todo:
        n = todo.pop()
        if n in seen or n not in nodes:
            continue
        seen.add(n)
        if "Kids" in nodes[n]:
            todo += reversed(pdf.references(nodes[n]["Kids"]))
        else:
            places[n] = len(places) + 1
            box = [float(x) for x in _inherited(nodes, n, "MediaBox").strip("[] ").split()] or [0, 0, 612, 792]
            contents = pdf.references(nodes[n].get("Contents")) if nodes[n].get("Contents") else []
            out.append((file, "page", places[n], 0, None, places[n], box[2] - box[0], box[3] - box[1], contents, list(_fonts(nodes, _inherited(nodes, n, "Resources")).items())))
    todo = [(pdf.reference(nodes.get(pdf.reference(root.get("Outlines")) or -1, {}).get("First")), 1)]
    k, seen = 0, set()
    while todo:
        n, level = todo.pop()
        if n in seen or n not in nodes:
            continue
        seen.add(n)
        k += 1
        target = pdf.references(nodes[n].get("Dest") or nodes[n].get("A"))
        out.append((file, "outline", k, level, " ".join(nodes[n].get("Title", "").split()), places.get(target[0]) if target else None, None, None, [], {}))
        todo += [(pdf.reference(nodes[n].get("Next")), level), (pdf.reference(nodes[n].get("First")), level + 1)]
    out.append((file, "file", len(places), 0, title, None, None, None, [], {}))
    return out


def structure(objects: DataFrame) -> DataFrame:
    """file, what, n, and what belongs to each: of a page its number, width, height, contents and fonts; of an outline entry its place, level, title and page (null if none); of a
    file the number of pages and the title in its information (null if none). Files whose tree of pages is broken have no pages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        file, nodes = None, {}
        for batch in batches:
            for name, number, entries in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if nodes and name != file:
                    yield from _structure(file, nodes)
                    nodes = {}
                file, nodes[number] = name, dict(entries)
        if nodes:
            yield from _structure(file, nodes)

    # a file's objects are few bytes but much work, so they are dealt out by number, not by size
    spark = objects.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = objects.filter("kind != 'stream'").select("file", "number", "entries").repartition(tasks, "file").sortWithinPartitions("file")
    return plain.mapInArrow(lambda batches: _batches(rows(batches), STRUCTURE_KINDS), STRUCTURE)


def runs(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """file, page, height, seq, kind (run or rule), block, x0, y0, x1, y1 (from the top), size, text of all pages. parts: what structure() gives.

    Each page gets its contents, in order, and its fonts' maps by joins with the streams of its file, and is read by itself.
    """
    pages = parts.filter("what = 'page'").select("file", "page", "height", "contents", "fonts")
    streams = objects.filter("kind = 'stream'").select("file", "number", "stream")
    wanted = pages.select("file", "page", F.posexplode("contents").alias("at", "number"), F.lit(None).cast("string").alias("font"))
    maps = pages.select("file", "page", F.explode("fonts").alias("font", "number")).select("file", "page", F.lit(-1).alias("at"), "number", "font")
    own = wanted.unionByName(maps).join(streams, ["file", "number"]).groupBy("file", "page").agg(
        F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "stream")))).alias("contents"),
        F.map_from_entries(F.collect_list(F.when(F.col("at") < 0, F.struct("font", "stream")))).alias("maps"),
    )
    full = own.join(pages.select("file", "page", "height"), ["file", "page"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, page, height, contents, maps = (batch.column(c)[k].as_py() for c in range(5))
                for seq, (kind, block, x0, y0, x1, y1, size, text) in enumerate(pdf.shown(b"\n".join(c["stream"] for c in contents), dict(maps))):
                    yield file, page, seq, kind, block, x0, height - y1, x1, height - y0, size, text

    return full.select("file", "page", "height", "contents", "maps").mapInArrow(lambda batches: _batches(rows(batches), RUN_KINDS), RUN)


def lines(shown: DataFrame) -> DataFrame:
    """file, page, seq, block, x0, y0, x1, y1, size (of the most characters), text: the runs of a text object on one base line, in their order."""
    line, box = ["file", "page", "block", "base"], [F.min("seq").alias("seq"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    # a page's runs meet in one place first, so that each page is read once and the groups within it need no shuffle of their own
    each = shown.filter("kind = 'run'").withColumn("base", F.round("y1", 1)).repartition("file", "page")
    sizes = each.groupBy(*line, F.round("size", 1).alias("size")).agg(F.sum(F.char_length("text")).alias("n"), *box, F.collect_list(F.struct("seq", "text")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("t"))), lambda s: s["text"]), "")
    return sizes.groupBy(*line).agg(*box, text.alias("text"), F.max_by("size", F.struct("n", "size")).alias("size")).drop("base")


def rules(shown: DataFrame) -> DataFrame:
    """file, page, x0, y0, x1, y1 of painted paths."""
    return shown.filter("kind = 'rule'").select("file", "page", "x0", "y0", "x1", "y1")


def document_titles(parts: DataFrame, largest: DataFrame) -> DataFrame:
    """file, n_pages, title: what the file says of itself, if it has 8 to 250 characters, else the largest line of the first page, else the file's name. largest: file, line."""
    own = F.trim(F.regexp_replace("title", r"\s+", " "))
    files = parts.filter("what = 'file'").select("file", F.col("n").alias("n_pages"), F.when(F.length(own).between(8, 250), own).alias("own"))
    return files.join(largest, "file", "left").select("file", "n_pages", F.coalesce("own", "line", "file").alias("title"))
