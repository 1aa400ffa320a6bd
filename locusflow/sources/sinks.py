"""Output tables, workbooks, compressed VCF and pages.

Large outputs are written by executors. What the driver writes is small by
nature (intervals, plots of a fixed number of points) or passes through it
block by block, already compressed.
"""

from __future__ import annotations

import html
import io
import json
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows a worksheet can hold.
SHEET_ROWS = 1_048_575
#: Points of a plotted chromosome.
POINTS = 1500
#: The empty block that ends a BGZF file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class _File:
    """A file in any file system that Spark reaches, written by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)

    def __enter__(self):
        return self

    def write(self, data: bytes) -> None:
        self._out.write(bytearray(data))

    def __exit__(self, *_):
        self._out.close()


def write_tsv(df: DataFrame, path: str, places: int) -> None:
    """A folder of tab-separated parts in the frame's order; floats with a fixed number of places, null empty."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.format_string(f"%.{places}f", c)
            c = F.when(F.col(f"`{name}`").isNotNull(), c)
        elif kind.startswith("array"):
            c = F.concat(F.lit("["), F.array_join(c.cast("array<string>"), " "), F.lit("]"))
        columns.append(c.alias(name))
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def _cell(value, ref: str) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{html.escape(str(value))}</t></is></c>'


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def workbook(columns: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet; null and NaN are empty cells."""
    lines = "".join(f'<row r="{r}">{"".join(_cell(v, f"{_letters(k)}{r}") for k, v in enumerate(row))}</row>' for r, row in enumerate([tuple(columns), *rows], 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="QTL" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def write_workbook(df: DataFrame, path: str) -> None:
    rows = df.limit(SHEET_ROWS + 1).collect()
    if len(rows) > SHEET_ROWS:
        raise ValueError("too many rows for a worksheet; write a table instead")
    with _File(df.sparkSession, path) as f:
        f.write(workbook(df.columns, [tuple(r) for r in rows]))


def bgzf_block(data: bytes) -> bytes:
    """One BGZF block (a gzip member that tells its own length) of at most 65,280 bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_vcf(lines: DataFrame, header: str, path: str) -> None:
    """``lines`` (chrom, pos, line) as BGZF in coordinate order. Executors sort and compress; the driver only joins blocks."""
    ordered = lines.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "line").select("line")

    def blocks(batches):
        import pyarrow as pa

        held = bytearray()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                held += line.encode() + b"\n"
                while len(held) > 65_280:
                    yield pa.RecordBatch.from_pydict({"block": [bgzf_block(bytes(held[:65_280]))]})
                    del held[:65_280]
        if held:
            yield pa.RecordBatch.from_pydict({"block": [bgzf_block(bytes(held))]})

    data = header.encode()
    with _File(lines.sparkSession, path) as f:
        for k in range(0, len(data), 65_280):
            f.write(bgzf_block(data[k : k + 65_280]))
        for row in ordered.mapInArrow(blocks, "block binary").toLocalIterator():
            f.write(bytes(row["block"]))
        f.write(BGZF_END)


def plot_points(markers: DataFrame, columns: list[str], points: int = POINTS) -> DataFrame:
    """Means over at most about ``points`` stretches of each chromosome."""
    span = markers.groupBy("chrom").agg(F.min("pos").alias("_a"), F.max("pos").alias("_z"))
    cut = markers.join(F.broadcast(span), "chrom").withColumn("_bin", F.floor((F.col("pos") - F.col("_a")) * points / F.greatest(F.col("_z") - F.col("_a") + 1, F.lit(1))))
    return cut.groupBy("chrom", "_bin").agg(F.avg("pos").alias("pos"), *[F.avg(c).alias(c) for c in columns]).orderBy("chrom", "_bin").drop("_bin")


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif;margin:2em}}canvas{{border:1px solid #ddd;display:block;margin:.3em 0 1.2em}}</style></head><body><h1>{title}</h1><div id="c"></div><script>
const data={data};const colours=["#1f5fa8","#b5532a","#3f7d4e","#7a4f9a","#8a6d1d","#4a4a4a"];
for(const chart of data){{const h=document.createElement("h3");h.textContent=chart.title;const k=document.createElement("canvas");k.width=1100;k.height=240;document.getElementById("c").append(h,k);const g=k.getContext("2d");
const xs=chart.x,all=chart.series.flatMap(s=>s.y).concat(chart.lines.map(l=>l.y)).filter(v=>v!==null),a=Math.min(...all),z=Math.max(...all),x0=xs[0],x1=xs[xs.length-1]||1;
const X=v=>50+(v-x0)/(x1-x0||1)*1030,Y=v=>220-(v-a)/(z-a||1)*200;g.fillStyle="#f2e6c9";for(const b of chart.areas)g.fillRect(X(b[0]),20,Math.max(1,X(b[1])-X(b[0])),200);
chart.series.forEach((s,i)=>{{g.strokeStyle=colours[i%6];g.beginPath();s.y.forEach((v,j)=>v===null||g[j?"lineTo":"moveTo"](X(xs[j]),Y(v)));g.stroke();g.fillStyle=colours[i%6];g.fillText(s.name,60+i*120,14)}});
g.setLineDash([5,4]);for(const l of chart.lines){{g.strokeStyle="#888";g.beginPath();g.moveTo(50,Y(l.y));g.lineTo(1080,Y(l.y));g.stroke();g.fillStyle="#666";g.fillText(l.name,4,Y(l.y))}}g.setLineDash([]);g.fillText(Math.round(x0/1e4)/100+" Mb",50,236);g.fillText(Math.round(x1/1e4)/100+" Mb",1030,236)}}
</script></body></html>"""


def page(title: str, charts: list[dict]) -> str:
    return _PAGE.format(title=html.escape(title), data=json.dumps(charts).replace("</", "<\\/"))


def write_pages(markers: DataFrame, blocks: DataFrame, mode: str, path: str) -> None:
    """Three pages: each statistic with its thresholds, all Z scores, and the composite with its blocks."""
    raw = [c for c in markers.columns if c.startswith("Sm_")]
    z = [c for c in markers.columns if c.startswith("Z_") and c not in ("Z_P99", "Z_P95")]
    limits = [c for c in markers.columns if "_P9" in c or "_Mp9" in c]
    points: dict[str, dict[str, list]] = {}
    for r in plot_points(markers, [*raw, *z, "CompositeZ"]).collect():
        of = points.setdefault(r["chrom"], {c: [] for c in ("pos", *raw, *z, "CompositeZ")})
        for c in of:
            of[c].append(r[c])
    means = {r["chrom"]: r for r in markers.groupBy("chrom").agg(*[F.avg(c).alias(c) for c in limits]).collect()}
    areas: dict[str, list] = {}
    for r in blocks.collect():
        areas.setdefault(r["chrom"], []).append([r["start"], r["stop"]])
    names = {"Sm_Gstat1": "OneBulkGstat", "Sm_LOD1": "OneBulkLOD", "Sm_BBLogBF1": "OneBulkBBLogBF"}
    pages: dict[str, list] = {"individual": [], "zscores": [], "composite": []}
    for chrom, of in sorted(points.items()):
        chart = lambda title, columns, lines, shade=(): {"title": title, "x": of["pos"], "series": [{"name": c, "y": of[c]} for c in columns], "lines": lines, "areas": list(shade)}  # noqa: B023, E731
        for c in raw:
            stat = names.get(c, c[3:])
            lines = [{"name": n.removeprefix(stat + "_"), "y": means[chrom][n]} for n in limits if n.startswith(f"{stat}_") and means[chrom][n] is not None]
            pages["individual"].append(chart(f"{chrom} {stat}", [c], lines))
        pages["zscores"].append(chart(chrom, z, [{"name": str(v), "y": v} for v in (-3, -2, 2, 3)]))
        lines = [{"name": n, "y": means[chrom][f"CompositeZ_{n}"]} for n in ("P99", "P95")]
        pages["composite"].append(chart(chrom, ["CompositeZ"], lines, areas.get(chrom, ())))
    for name, charts in pages.items():
        with _File(markers.sparkSession, f"{path}/{mode}.{name}.html") as f:
            f.write(page(f"{mode} {name}", charts).encode())
