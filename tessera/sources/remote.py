"""Files and archive members from remote hosts, of known size and hash; registries and manifests that name them.

Fetching is the driver's: a file is streamed, checked against its manifest and only then put in place.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path
from urllib.parse import urlparse
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 64 * 1024
_LOCAL = struct.Struct("<4s5H3I2H")  # fixed format: a ZIP member's local header
_SIGNATURE, _DEFLATED = b"PK\x03\x04", 8


class AcquisitionError(RuntimeError):
    pass


def _demand(holds: bool, otherwise: str) -> None:
    if not holds:
        raise AcquisitionError(otherwise)


def on_host(url: str, host: str) -> bool:
    parsed = urlparse(url)
    return parsed.scheme == "https" and (parsed.hostname or "").lower() == host


@dataclass(frozen=True)
class RemoteFile:
    url: str
    host: str
    size: int
    sha256: str

    def check(self, most: int) -> None:
        digest = self.sha256.strip().lower()
        _demand(on_host(self.url, self.host), "the file is not on the allowed HTTPS host")
        _demand(0 < self.size <= most, "the file is larger than allowed")
        _demand(len(digest) == 64 and not set(digest) - set("0123456789abcdef"), "the manifest's hash is invalid")


@dataclass(frozen=True)
class ZipMember:
    url: str
    host: str
    archive_size: int
    etag: str
    member: str
    header_at: int
    crc32: int
    compressed: int
    size: int
    method: int = _DEFLATED

    def check(self, most_compressed: int, most: int) -> None:
        _demand(on_host(self.url, self.host), "the archive is not on the allowed HTTPS host")
        _demand(self.method == _DEFLATED, "only deflated members are supported")
        _demand(0 < self.compressed <= most_compressed and 0 < self.size <= most, "the member is larger than allowed")
        _demand(0 <= self.header_at < self.archive_size, "the member's header lies outside the archive")


@dataclass(frozen=True)
class Acquired:
    path: str
    sha256: str
    crc32: str
    size: int
    downloaded: int
    outcome: str  # downloaded or unchanged


def _measure(chunks: Iterable[bytes]) -> Iterator[tuple[bytes, "hashlib._Hash", int, int]]:
    """Each chunk with hash, checksum and size so far."""
    digest, crc, size = hashlib.sha256(), 0, 0
    for chunk in chunks:
        digest.update(chunk)
        crc, size = zlib.crc32(chunk, crc), size + len(chunk)
        yield chunk, digest, crc, size


def _chunks(file) -> Iterator[bytes]:
    return iter(lambda: file.read(STEP), b"")


def _place(target: Path, chunks: Iterable[bytes], most: int, downloaded: int | None, right: Callable[[str, int, int], bool]) -> Acquired:
    """Streams to a temporary neighbour of ``target``, which takes its name if all is right and never replaces another."""
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    digest, crc, size = hashlib.sha256(), 0, 0
    try:
        with part.open("xb") as out:
            for chunk, digest, crc, size in _measure(chunks):
                _demand(size <= most, "more bytes came than the manifest says")
                out.write(chunk)
        _demand(right(digest.hexdigest(), crc, size), "what came is not what the manifest says")
        os.link(part, target)
    finally:
        part.unlink(missing_ok=True)
    return Acquired(str(target), digest.hexdigest(), f"{crc:08x}", size, size if downloaded is None else downloaded, "downloaded")


def _present(target: Path, right: Callable[[str, int, int], bool]) -> Acquired | None:
    if not target.exists():
        return None
    digest, crc, size = hashlib.sha256(), 0, 0
    with target.open("rb") as file:
        for _, digest, crc, size in _measure(_chunks(file)):
            pass
    _demand(right(digest.hexdigest(), crc, size), "the file that is there is another")
    return Acquired(str(target), digest.hexdigest(), f"{crc:08x}", size, 0, "unchanged")


def acquire_file(spec: RemoteFile, target: Path, *, most: int = 32 << 20, opener: Callable = urlopen) -> Acquired:
    """The file at ``target``, fetched unless it is there already; a redirect to another host is an error."""
    spec.check(most)
    right = lambda digest, crc, size: (digest, size) == (spec.sha256.strip().lower(), spec.size)
    if there := _present(target, right):
        return there
    with opener(Request(spec.url), timeout=60) as response:
        _demand(on_host(response.geturl(), spec.host), "the file was redirected to another host")
        return _place(target, _chunks(response), spec.size, None, right)


def _range(spec: ZipMember, first: int, last: int, opener: Callable) -> Iterator[bytes]:
    request = Request(spec.url, headers={"Range": f"bytes={first}-{last}", "If-Match": spec.etag})
    with opener(request, timeout=60) as response:
        _demand(on_host(response.geturl(), spec.host), "the archive was redirected to another host")
        _demand(response.status == 206, "the host sent no part of the archive")
        _demand(response.headers.get("Content-Range") == f"bytes {first}-{last}/{spec.archive_size}", "the host sent another part")
        left = last - first + 1
        for chunk in _chunks(response):
            left -= len(chunk)
            _demand(left >= 0, "the host sent more than was asked for")
            yield chunk
        _demand(left == 0, "the host sent less than was asked for")


def _inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    inflate = zlib.decompressobj(-zlib.MAX_WBITS)
    for chunk in chunks:
        while chunk:
            if out := inflate.decompress(chunk, STEP):
                yield out
            chunk = inflate.unconsumed_tail
    yield inflate.flush()
    _demand(inflate.eof and not inflate.unused_data, "the member's data is broken")


def acquire_zip_member(spec: ZipMember, target: Path, *, most_compressed: int = 16 << 20, most: int = 64 << 20, opener: Callable = urlopen) -> Acquired:
    """One member of a remote archive by ranges: its local header, then its data."""
    spec.check(most_compressed, most)
    with opener(Request(spec.url, method="HEAD"), timeout=60) as response:
        _demand(on_host(response.geturl(), spec.host), "the archive was redirected to another host")
        headers = response.headers
        _demand(headers.get("Content-Length") == str(spec.archive_size) and headers.get("ETag") == spec.etag, "the archive has changed")
    right = lambda digest, crc, size: (crc, size) == (spec.crc32, spec.size)
    if there := _present(target, right):
        return there
    header = _LOCAL.unpack(b"".join(_range(spec, spec.header_at, spec.header_at + _LOCAL.size - 1, opener)))
    signature, _, flags, method, _, _, crc, compressed, size, name, extra = header
    _demand(signature == _SIGNATURE and method == spec.method and not flags & 1, "the member's header is another")
    _demand(bool(flags & 8) or (crc, compressed, size) == (spec.crc32, spec.compressed, spec.size), "the member's header has other sizes")
    at = spec.header_at + _LOCAL.size
    _demand(b"".join(_range(spec, at, at + name - 1, opener)).decode() == spec.member, "the member's header has another name")
    data = at + name + extra
    return _place(target, _inflated(_range(spec, data, data + spec.compressed - 1, opener)), spec.size, spec.compressed, right)


def write_acquisition(result: Acquired, source: dict, path: Path) -> None:
    """The manifest of an acquired file, beside it."""
    path.write_text(json.dumps({"acquired": asdict(result), "source": source}, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, version, license_review_status, permitted_scopes, file) of a registry: one row a file, which must be whole."""
    file = "struct<name: string, purposes: array<string>, path: string, source_url: string, allowed_hostname: string, size_bytes: bigint, sha256: string>"
    kind = f"array<struct<name: string, version: string, license_review_status: string, permitted_scopes: array<string>, files: array<{file}>>>"
    sets = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("d"))
    rows = sets.select(F.col("d.name").alias("dataset"), "d.version", F.coalesce("d.license_review_status", F.lit("unrecorded")).alias("license_review_status"), "d.permitted_scopes", F.explode("d.files").alias("file"))
    whole = F.col("permitted_scopes").isNotNull() & (F.size("file.purposes") > 0) & (F.col("file.size_bytes") > 0)
    for c in ("name", "path", "source_url", "allowed_hostname", "sha256"):
        whole = whole & F.col(f"file.{c}").isNotNull()
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("file")).otherwise(F.raise_error(F.concat(F.lit("a file of this dataset is not wholly registered: "), "dataset")).cast(file))
    return rows.withColumn("file", checked)


def file_for(registry: DataFrame, dataset: str, purposes: Sequence[str]) -> dict:
    """The one file of a dataset that serves any of the purposes."""
    found = registry.where((F.col("dataset") == dataset) & F.arrays_overlap("file.purposes", F.array(*map(F.lit, purposes)))).select("file.*").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{dataset} must register exactly one file for {', '.join(purposes)}")
    return found[0].asDict()


def licence_status(datasets: DataFrame, reviews: DataFrame) -> DataFrame:
    """Datasets (dataset, ...) with the status of their review, ``unrecorded`` where there is none."""
    return datasets.join(reviews.select("dataset", "license_review_status"), "dataset", "left").withColumn("license_review_status", F.coalesce("license_review_status", F.lit("unrecorded")))


def parse_manifest(manifests: DataFrame, *, value: str = "value") -> DataFrame:
    """(source_url, case_ordinals) of manifests that are JSON arrays of URLs or of {url, case_ordinals}; other entries are errors."""
    entry = F.explode(F.variant_get(F.parse_json(value), "$", "array<variant>")).alias("e")
    rows = manifests.select(entry)
    kind = F.schema_of_variant("e")
    ordinals = F.try_variant_get("e", "$.case_ordinals", "array<variant>")
    whole = F.coalesce(F.forall(ordinals, lambda o: (F.schema_of_variant(o) == "BIGINT") & (F.variant_get(o, "$", "bigint") > 0)), F.try_variant_get("e", "$.case_ordinals", "variant").isNull())
    named = F.schema_of_variant(F.try_variant_get("e", "$.url", "variant")) == "STRING"
    url = F.trim(F.when(kind == "STRING", F.try_variant_get("e", "$", "string")).when(whole & named, F.try_variant_get("e", "$.url", "string")))
    checked = F.when(F.coalesce(url != "", F.lit(False)), url).otherwise(F.raise_error(F.lit("a manifest's entries are URLs or objects with a URL and whole ordinals")).cast("string"))
    numbers = F.when(kind != "STRING", F.array_distinct(F.transform(ordinals, lambda o: F.variant_get(o, "$", "int"))))
    return rows.select(checked.alias("source_url"), F.coalesce(numbers, F.array().cast("array<int>")).alias("case_ordinals"))
