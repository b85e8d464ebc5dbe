"""Files read in byte ranges, at every size of a range, against plain parsers."""

import gzip
import random
import re
import struct
import zlib

import pytest
from revstrand.config import AssemblyConfig
from revstrand.operators import irmode as I
from revstrand.sources import contigs as C
from revstrand.sources import ranges as R
from revstrand.sources import readers

from .test_kernels import dna, rc


def bgzf(raw: bytes, each: int) -> bytes:
    """A file of gzip blocks of `each` bytes that carry their length, ended by the empty block."""
    out = b""
    for body in [*(raw[i : i + each] for i in range(0, len(raw), each)), b""]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        deflated = z.compress(body) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(deflated) + 25) + deflated + struct.pack("<II", zlib.crc32(body), len(body))
    return out


def ranges_of(path, size):
    return (R.Range(*x) for x in R.planned([(str(path), path.stat().st_size)], size))


FASTA = b"".join(
    [b">one first\r\n", b"acgtnnRYacgt\r\n" * 3, b"\r\n", b">empty\n", b">two > x\n", b"ACGT" * 9 + b"\n\n", b"TTTT>GG\n", b">three\n", b"A" * 50, b"\n>4\nC\n", b">five a long header " + b"x" * 40 + b"\n", b"GATTACA" * 4]
)


def plain_fasta(raw: bytes) -> dict:
    out, name = {}, None
    for line in raw.split(b"\n"):
        if line.startswith(b">"):
            name = line[1:].rstrip(b"\r").decode()
            out[name] = ""
        elif name is not None:
            out[name] += re.sub(r"[^ACGTRYKMBDHVSWN]", "N", re.sub(r"\s", "", line.decode()).upper())
    return {k: v for k, v in out.items() if v}


def joined(rows) -> dict:
    out: dict = {}
    for c, start, piece in sorted(rows):
        assert len(out.setdefault(c, "")) == start
        out[c] += piece.decode()
    return out


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_fasta_pieces_at_every_cut(spark, tmp_path, size):
    (tmp_path / "a.fa").write_bytes(FASTA)
    got = C.read_pieces(spark, str(tmp_path / "a.fa"), size, 16)
    rows = [(r["contig"], r["start"], bytes(r["piece"])) for r in got.collect()]
    assert joined(rows) == plain_fasta(FASTA)
    assert all(s // 16 == (s + len(p) - 1) // 16 for _, s, p in rows)  # no piece crosses the grid


@pytest.mark.parametrize("each, size", [(11, 1), (30, 200), (64, 10_000)])
def test_fasta_in_blocks_and_gzip(spark, tmp_path, each, size):
    (tmp_path / "b.fa.gz").write_bytes(bgzf(FASTA, each))
    with gzip.open(tmp_path / "c.fa.gz", "wb") as f:
        f.write(FASTA)
    for name in ("b.fa.gz", "c.fa.gz"):
        got = C.read_pieces(spark, str(tmp_path / name), size, 16)
        assert joined([(r["contig"], r["start"], bytes(r["piece"])) for r in got.collect()]) == plain_fasta(FASTA), name
    assert len(list(ranges_of(tmp_path / "c.fa.gz", size))) == 1


def test_long_lines_stream_from_gzip(spark, tmp_path, monkeypatch):
    body = dna(3 << 20, 5)
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write(f">one\n{body}\n>two\n{body[:100]}")
    rows = C.read_pieces(spark, str(tmp_path / "c.fa.gz"))
    assert joined([(r["contig"], r["start"], bytes(r["piece"])) for r in rows.collect()]) == {"one": body, "two": body[:100]}


def test_bases_before_a_header_are_refused(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"ACGT\n>x\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        C.read_pieces(spark, str(tmp_path / "a.fa"), 3).collect()
    (tmp_path / "b.fa").write_bytes(b"")
    assert C.read_pieces(spark, str(tmp_path / "b.fa")).collect() == []


def test_calls_from_pieces_of_seven_bases(spark, tmp_path):
    """Windows, hits and arms of pieces equal those of whole contigs, wherever ranges and pieces end."""
    a = dna(700, 1)
    rows = {"c0": dna(500, 2) + a + dna(90, 3) + rc(a) + "NNN" + dna(900, 4), "c1": dna(2500, 5), "c2": (b := dna(800, 6)) + rc(b), "c3": "ACGT"}
    (tmp_path / "a.fa").write_text("".join(f">{k}\n" + "\n".join(v[i : i + 61] for i in range(0, len(v), 61)) + "\n" for k, v in rows.items()))
    cfg = AssemblyConfig(min_matches=8, min_arm=150, window_len=1500, step=400, dedup=60, max_interval=3000)
    whole = spark.createDataFrame(list(rows.items()), "contig string, seq string")
    small = C.read_pieces(spark, str(tmp_path / "a.fa"), 97, 7)
    assert sorted(I.windows(whole, cfg).collect()) == sorted(I.windows(small, cfg).collect())
    want, got = (sorted(I.call_irs(x, cfg).collect(), key=str) for x in (whole, small))
    assert got == want and {r["contig"] for r in got} == {"c0", "c2"}


def hostile_fastq(n: int) -> tuple[bytes, list]:
    r, out, want = random.Random(n), b"", []
    for i in range(n):
        seq = "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 5, 30, 90])))
        qual = "".join(r.choice("@+I#>A") for _ in seq)
        end = r.choice(["\n", "\r\n"])
        out += f"@r{i} @x +{end}{seq}{end}+{r.choice(['', f'r{i} @x +'])}{end}{qual}{end}".encode()
        want.append((f"r{i} @x +", seq))
    return out[:-1] if n % 2 else out, want


def test_fastq_records_at_every_cut(tmp_path):
    raw, want = hostile_fastq(31)
    (tmp_path / "a.fq").write_bytes(raw)
    for size in [*range(1, 60), 100, 257, 5000]:
        got = []
        for r in ranges_of(tmp_path / "a.fq", size):
            with r:
                got += readers.records_of(r)
        assert got == want, size
    for each in (3, 17, 64, 300):
        (tmp_path / "b.fq.gz").write_bytes(bgzf(raw, each))
        for size in (1, 50, 333, 100_000):
            got = []
            for r in ranges_of(tmp_path / "b.fq.gz", size):
                with r:
                    got += readers.records_of(r)
            assert got == want, (each, size)


def test_fastq_source_has_a_task_per_range(spark, tmp_path):
    raw, want = hostile_fastq(400)
    (tmp_path / "a.fq").write_bytes(raw)
    rows = readers.read_fastq(spark, str(tmp_path / "a.fq"), size=2000, place=True)
    assert rows.rdd.getNumPartitions() == -(-len(raw) // 2000)
    assert [(r["read_id"], r["seq"]) for r in rows.orderBy(*readers.PLACE).collect()] == want
    (tmp_path / "bad.fq").write_bytes(b"@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="broken FASTQ record"):
        readers.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
