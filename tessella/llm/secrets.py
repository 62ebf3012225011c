"""Secret scanning with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. A
ledger holds one row for each (blob, rule version) pair scanned so far, with its
findings; a scan reads only the blobs that lack a pair, once each, and findings
are joined back to all versions that hold the blob. A new rule version makes all
blobs unseen for that rule only.

Copies of a text are dropped before and after the one shuffle of blobs (partial
aggregation), so a large group of copies sends one text from each partition.

Defined results: null text is the empty blob; a blob without findings is still
in the ledger; repeated rows each get their blob's findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stored

#: Kinds of the base rules, in their listed order.
BASE_KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Published token formats beyond the base kinds: (kind, literal that every match holds, pattern).
_VENDOR = (
    ("pem", b"PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    ("jwt", b"eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    ("slack", b"xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("github", b"gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("google", b"AIza", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEX_MASK = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))


def scan_base(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """The base kinds; a literal that every match holds is looked for before the pattern."""
    out = []
    low = raw.translate(_LOWER)
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    if b"x" * 24 in raw.translate(_HEX_MASK):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def scan_vendor(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, literal, p in _VENDOR if literal in raw for m in p.finditer(text)]


#: Rule name -> (version, scanner). A changed scanner gets a new version.
RULES = {"base": (1, scan_base), "vendor": (1, scan_vendor)}
KIND_ORDER = (*BASE_KINDS, *(k for k, _, _ in _VENDOR))

LEDGER = "blob string, rule string, version int, findings array<struct<kind:string,start:int,end:int>>"


def _scanner(rules):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # texts can be long
                part = batch.slice(at, 256)
                texts = part.column("text")
                blobs, names, versions, found = [], [], [], []
                for blob, raw, seen in zip(part.column("blob").to_pylist(), texts.cast(pa.large_binary()).to_pylist(), part.column("seen").to_pylist(), strict=True):
                    text = raw.decode("utf-8")
                    for name, (version, scan) in rules.items():
                        if f"{name}:{version}" in seen:
                            continue
                        blobs.append(blob)
                        names.append(name)
                        versions.append(version)
                        found.append([{"kind": k, "start": a, "end": b} for k, a, b in scan(text, raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blobs, pa.string()), pa.array(names, pa.string()), pa.array(versions, pa.int32()), pa.array(found, kind)],
                    ["blob", "rule", "version", "findings"],
                )

    return run


def blob_of(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: dict = RULES) -> DataFrame:
    """New ledger rows: findings of each (blob, rule version) pair of ``versions`` that ``ledger`` lacks."""
    blobs = versions.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        wanted = [f"{n}:{v}" for n, (v, _) in rules.items()]
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
        blobs = (
            blobs.join(seen, "blob", "left")
            .withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
            .where(F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col("seen"))) > 0)
        )
    return blobs.select("blob", "text", "seen").mapInArrow(_scanner(rules), LEDGER)


def update(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: dict = RULES) -> DataFrame:
    """The ledger after scanning ``versions``, written to the shared folder."""
    new = stored(scan_unseen(versions, ledger, text, rules), "ledger")
    return new if ledger is None else ledger.unionByName(new)


def findings(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: dict = RULES) -> tuple[DataFrame, str]:
    """``versions`` with a column of their findings under the given rule versions, by start, then kind as listed.

    Only blobs with findings take part in the join, so most rows meet no partner
    and a hot blob is one row on its side.
    """
    name = fresh(versions, "findings")
    key = fresh(versions, "blob")
    current = F.lit(False)
    for n, (v, _) in rules.items():
        current |= (F.col("rule") == n) & (F.col("version") == v)
    rank = F.create_map(*[x for i, k in enumerate(KIND_ORDER) for x in (F.lit(k), F.lit(i))])
    flat = F.flatten(F.collect_list("findings"))
    ordered = F.array_sort(F.transform(flat, lambda f: F.struct(f["start"].alias("start"), rank[f["kind"]].alias("rank"), f["end"].alias("end"), f["kind"].alias("kind"))))
    with_findings = ledger.where(current & (F.size("findings") > 0)).groupBy(F.col("blob").alias(key)).agg(ordered.alias(name))
    out = versions.withColumn(key, blob_of(text)).join(with_findings, key, "left")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return out.select(*[F.col(f"`{c}`") for c in versions.columns], F.coalesce(F.col(name), empty).alias(name)), name


def secret_report(versions: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, counts of the base kinds, the digest of the base spans, and all spans."""
    ledger = update(versions, None, text)
    slim = versions.select(*keep, text)
    out, name = findings(slim, ledger, text)
    f = F.col(name)
    say = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(f, lambda x: x["rank"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(*keep, *[count(k) for k in BASE_KINDS], F.sha2(say(base), 256).alias("base_sha256"), say(f).alias("spans"))
