"""Sinks: corrected FASTA, report TSV, inverted-repeat TSV and FASTA, HTML report."""

from __future__ import annotations

import html
import json
import os
import shutil
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..storage import write_text, written
from .contigs import parts

# Columns of the report and of the inverted-repeat table, in file order.
REPORT = (
    "read_id", "len", "event", "called", "coarse_split", "refined_split", "delta", "matches", "span_p1", "p2_span", "cross_frac", "coarse_score", "refined_score",
    "identity_est", "gap_est", "support_n", "support_rank_frac", "support_span", "decision",
)
IR = (
    "contig", "start", "end", "name", "score", "strand", "break_pos", "identity_est", "tir_ident", "matches", "span", "la0", "la1", "ra0", "ra1", "contig_len",
    "win_start", "win_end", "kept_pts", "bin", "arm_len", "spacer", "ir_class",
)
CLASSIFIED = ("arm_len", "spacer", "ir_class")


def corrected_fasta(corrected: DataFrame) -> DataFrame:
    """One text value per record of corrected(read_id, seq_out); sequences aren't wrapped."""
    return corrected.select(F.concat(F.lit(">"), F.coalesce("read_id", F.lit("")), F.lit("\n"), F.coalesce("seq_out", F.lit(""))).alias("value"))


def write_corrected_fasta(corrected: DataFrame, path: str, **options) -> None:
    """Every read once, in no particular order, as text files of the path."""
    corrected_fasta(corrected).write.options(**options).text(path)


def write_single_file(lines: DataFrame, path: str, order: tuple[str, ...] = (), header: str = "") -> None:
    """One text file of lines(value, ...) in the order of columns, written by many tasks.

    Tasks write their lines into parts of their own; a prefix sum over the parts' sizes says where each part belongs, and a second
    pass puts it there. Attempts have parts of their own names and a part is always put at the same place, so tasks can run again.
    The file takes its name when it is whole. Its folder must be one that all executors reach as a local one and write into at any
    offset, which object stores don't allow: there, folders of parts are the way. A path that exists is refused. Null lines are empty.
    """
    spark, at = lines.sparkSession, path.removeprefix("file://")
    if "://" in at:
        raise ValueError(f"tasks can't write into the middle of a file at {path}")
    if os.path.exists(at):
        raise FileExistsError(at)
    folder = f"{at}.parts-{uuid.uuid4().hex}"
    os.makedirs(folder)
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines

    def put(batches):
        name, size = f"{folder}/{uuid.uuid4().hex}", 0
        with open(name, "wb") as f:
            for b in batches:
                size += f.write("".join(f"{x or ''}\n" for x in b.column("value").to_pylist()).encode())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [name], "n": [size]})

    parts = written(rows.select("value").mapInArrow(put, "part long, file string, n long"), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    first = f"{header}\n".encode() if header else b""
    placed = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) + len(first))
    with open(f"{folder}/whole", "wb") as f:
        f.write(first)
        f.truncate(len(first) + (parts.agg(F.sum("n")).first()[0] or 0))

    def place(batches):
        for b in batches:
            for name, offset in zip(b.column("file").to_pylist(), b.column("offset").to_pylist()):
                with open(name, "rb") as one, open(f"{folder}/whole", "r+b") as f:
                    f.seek(offset)
                    while body := one.read(1 << 20):
                        f.write(body)
            yield b.select(["part"])

    n = max(min(parts.count(), 4 * spark.sparkContext.defaultParallelism), 1)
    placed.repartition(n).mapInArrow(place, "part long").write.format("noop").mode("overwrite").save()
    os.rename(f"{folder}/whole", at)
    shutil.rmtree(folder)


def tsv_lines(t: DataFrame, *order: str) -> DataFrame:
    """value, a line per row of a table of strings, besides the columns that it is ordered by."""
    return t.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in t.columns]).alias("value"), *order)


def report_tsv(report: DataFrame) -> DataFrame:
    """The 19 columns as they are printed: identity with 3 and rank with 6 decimals, empty where nothing is known."""
    show = {"identity_est": F.format_string("%.3f", F.col("identity_est").cast("double")), "support_rank_frac": F.format_string("%.6f", F.col("support_rank_frac").cast("double"))}
    return report.select(*[F.when(F.col(c).isNotNull(), show.get(c, F.col(c).cast("string"))).otherwise("").alias(c) for c in REPORT])


def _write_tsv(df: DataFrame, path: str, header: list[str]) -> None:
    df.toDF(*header).write.option("sep", "\t").option("header", True).option("emptyValue", "").option("comment", "\u0001").option("escapeQuotes", False).csv(path)


def write_report_tsv(report: DataFrame, path: str) -> None:
    _write_tsv(report_tsv(report), path, list(REPORT))


def _ident(c: str) -> Column:
    return F.when(F.col(c).isNull() | F.isnan(c), "NaN").otherwise(F.format_string("%.3f", F.col(c).cast("double")))


def ir_tsv(calls: DataFrame, classify: bool = True) -> DataFrame:
    """20 columns, 23 with the classification; a missing arm identity prints NaN."""
    names = [c for c in IR if classify or c not in CLASSIFIED]
    return calls.select(*[_ident(c).alias(c) if c in ("identity_est", "tir_ident") else F.col(c).cast("string").alias(c) for c in names])


def write_ir_tsv(calls: DataFrame, path: str, classify: bool = True) -> None:
    t = ir_tsv(calls, classify)
    _write_tsv(t, path, ["#" + t.columns[0], *t.columns[1:]])


def ir_fasta(calls: DataFrame, contigs: DataFrame, width: int = 60) -> DataFrame:
    """Each call's interval under a header that names its evidence; width 0 leaves one line. contigs: (contig, seq), or pieces.

    Intervals are put together from the pieces that they touch, so a contig is never copied to its calls.
    """
    spacer = F.when(F.col("la1") > F.col("la0"), F.col("spacer"))
    head = F.concat(
        F.lit(">"), "contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("|break="), F.col("break_pos").cast("string"),
        F.lit("|ident="), S.milli(F.col("identity_est")), F.lit("|tir_ident="), F.when(F.col("tir_ident").isNull(), "NaN").otherwise(S.milli(F.col("tir_ident"))),
        F.lit("|matches="), F.col("matches").cast("string"), F.lit("|span="), F.col("span").cast("string"), F.lit("|bin="), F.col("bin").cast("string"),
        F.lit("|class="), S.ir_class_fasta(spacer), F.lit("|spacer="), F.coalesce(spacer.cast("string"), F.lit("NA")),
    )
    need = calls.select(head.alias("head"), "contig", F.col("start").alias("lo"), F.col("end").alias("hi"))
    found = parts(need, contigs).groupBy("head").agg(F.array_sort(F.collect_set(F.struct("start", "part"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["part"].cast("string")), "")
    rows = need.select("head").join(found, "head", "left")
    return rows.select(F.concat("head", F.lit("\n"), S.wrap(F.coalesce(body, F.lit("")), width)).alias("value"))


def write_ir_fasta(calls: DataFrame, contigs: DataFrame, path: str, width: int = 60) -> None:
    ir_fasta(calls, contigs, width).write.text(path)


_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>
body{{font:14px sans-serif;margin:2em}}td,th{{padding:2px 8px;text-align:right;border-bottom:1px solid #ddd}}th{{cursor:pointer}}
label{{margin-right:1em}}.charts{{display:flex;flex-wrap:wrap;gap:2em}}svg{{background:#fafafa}}rect{{fill:#47a}}</style></head>
<body><h1>{title}</h1><p id="n"></p><div id="controls">{controls}</div><div class="charts" id="charts"></div><p><button id="cprev">previous</button> <span id="cpage"></span> <button id="cnext">next</button></p><div id="contigs"></div>
<p><button id="prev">previous</button> <span id="page"></span> <button id="next">next</button></p>
<table><thead><tr id="h"></tr></thead><tbody id="b"></tbody></table>
<script>const rows=[];function push(r){{rows.push(r)}}</script>
{data}
<script>
const PAGE=200,CPAGE=25,BINS=30,cols={columns};let page=0,cpage=0,kept=[],byContig=[],by=null,up=true;
const el=i=>document.getElementById(i),v=i=>+el(i).value;
function chosen(){{return new Set([...document.querySelectorAll('.cls')].filter(c=>c.checked).map(c=>c.value))}}
function bars(name,values,lo,hi){{const n=Array(BINS).fill(0);for(const x of values)if(x>=lo&&x<=hi)n[Math.min(BINS-1,Math.floor((x-lo)/(hi-lo)*BINS))]++;
const top=Math.max(1,...n);let s='<figure><figcaption>'+name+' ('+lo+' to '+hi+')</figcaption><svg width="300" height="120">';
n.forEach((c,i)=>{{const h=110*c/top;s+='<rect x="'+i*10+'" y="'+(120-h)+'" width="9" height="'+h+'"><title>'+c+'</title></rect>'}});return s+'</svg></figure>'}}
function filter(){{const k=chosen();kept=rows.filter(r=>r.tir_ident!=null&&r.tir_ident>=v('tir_ident')&&r.kept_pts>=v('kept_pts')&&r.matches>=v('matches')&&r.arm_len>=v('arm_len')&&r.spacer>=v('spacer')&&k.has(r.ir_class));
if(by)kept.sort((a,b)=>(a[by]>b[by]?1:a[by]<b[by]?-1:0)*(up?1:-1));page=0;
const m=Math.max(1,...kept.map(r=>r.end-r.start));
el('charts').innerHTML=bars('arm identity',kept.map(r=>r.tir_ident),0,1)+bars('interval length',kept.map(r=>r.end-r.start),0,m)+bars('spacer',kept.map(r=>r.spacer),0,Math.max(1,...kept.map(r=>r.spacer)));
const c={{}};for(const r of kept)(c[r.contig]=c[r.contig]||{{len:r.contig_len,calls:[]}}).calls.push(r);
byContig=Object.entries(c).sort((a,b)=>b[1].calls.length-a[1].calls.length);cpage=0;places();draw()}}
function places(){{const last=Math.max(0,Math.ceil(byContig.length/CPAGE)-1);cpage=Math.min(Math.max(cpage,0),last);const list=document.createElement('ul');
for(const [k,x] of byContig.slice(cpage*CPAGE,(cpage+1)*CPAGE)){{const li=document.createElement('li'),t=document.createElement('div'),g=document.createElement('div');t.textContent=k+': '+x.calls.length+' calls, '+x.len+' bases';
const at=p=>600*p/Math.max(1,x.len),arm=(a,z,y)=>'<rect x="'+at(a)+'" y="'+y+'" width="'+Math.max(1,at(z)-at(a))+'" height="6"/>';let s='<svg width="600" height="20"><line x1="0" x2="600" y1="10" y2="10" stroke="#888"/>';
for(const r of x.calls)s+='<g><title>'+r.start+' to '+r.end+'</title>'+arm(r.la0,r.la1,2)+arm(r.ra0,r.ra1,12)+'</g>';g.innerHTML=s+'</svg>';li.append(t,g);list.append(li)}}
el('contigs').replaceChildren(list);el('cpage').textContent=(cpage+1)+' / '+(last+1)+' of '+byContig.length+' contigs'}}
function draw(){{const last=Math.max(0,Math.ceil(kept.length/PAGE)-1);page=Math.min(Math.max(page,0),last);
el('n').textContent=kept.length+' of '+rows.length+' calls';el('page').textContent=(page+1)+' / '+(last+1);
const t=el('b');t.replaceChildren();for(const r of kept.slice(page*PAGE,(page+1)*PAGE)){{const e=t.insertRow();for(const c of cols)e.insertCell().textContent=r[c]??''}}}}
for(const c of cols){{const h=document.createElement('th');h.textContent=c;h.onclick=()=>{{up=by===c?!up:true;by=c;filter()}};el('h').append(h)}}
el('cprev').onclick=()=>{{cpage--;places()}};el('cnext').onclick=()=>{{cpage++;places()}};
el('prev').onclick=()=>{{page--;draw()}};el('next').onclick=()=>{{page++;draw()}};
document.querySelectorAll('input').forEach(i=>i.oninput=filter);filter();</script></body></html>"""
#: Fixed defaults of the page's filters, and the classes that can be shown.
FILTERS = {"tir_ident": 0.5, "kept_pts": 50, "matches": 50, "arm_len": 500, "spacer": 0}
CLASSES = ("overlap", "immediate", "spaced", "wide")


def _page(calls: DataFrame, title: str, data: str) -> str:
    controls = "".join(f'<label>{k} <input id="{k}" type="number" step="any" value="{v}"></label>' for k, v in FILTERS.items())
    controls += "".join(f'<label><input class="cls" type="checkbox" value="{c}" checked> {c}</label>' for c in CLASSES)
    return _PAGE.format(title=html.escape(title), controls=controls, data=data, columns=json.dumps(calls.columns))


def _rows(calls: DataFrame) -> DataFrame:
    """A script line per call, best first."""
    whole = F.to_json(F.struct(*calls.columns), {"ignoreNullFields": "false"})
    return calls.orderBy(F.desc("score"), F.desc("matches"), "contig", "start").select(F.concat(F.lit("push("), F.replace(whole, F.lit("</"), F.lit("<\\/")), F.lit(");")).alias("value"))


def html_report(calls: DataFrame, title: str) -> str:
    """One page with every call, the dashboard's filters and charts. All calls come to the driver: `write_html_report` is for many."""
    return _page(calls, title, "<script>" + "\n".join(r[0] for r in _rows(calls).toLocalIterator()) + "</script>")


def write_html_report(calls: DataFrame, path: str, title: str) -> None:
    """A folder with index.html and every call in script files beside it, written by the tasks."""
    spark = calls.sparkSession
    _rows(calls).write.text(f"{path}/rows")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    names = sorted(s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))
    data = "\n".join(f'<script src="rows/{n}"></script>' for n in names if n.startswith("part-"))
    write_text(spark, f"{path}/index.html", _page(calls, title, data))
