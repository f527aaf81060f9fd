"""What the operators share: tables, shared scratch tables, and vectorised word hashing."""

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the operators' contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(col):
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names. Where none is set a local session gets a temporary one; on a cluster, whose
    machines would not see it, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_by_hand.get() if set_by_hand.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Rows of small tables that a task handles.
TASK_ROWS = 10_000
#: Rows and bytes that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold, whatever the rows' length, unless the session asks for less."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Written tables in the shared folder. They cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{scratch_root(spark)}/foliospark-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.made = 0
        bound_batches(spark)
        atexit.register(self._clean)

    def write(self, name: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df, written and read again. rows, where given, is as many as it has at most: a small table then
        needs few tasks and files."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
        self.made += 1
        path = self.paths[name] = f"{self.top}/{self.made:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name))

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        try:
            self._delete(self.top)
        except Exception:  # the session has ended: the folder is the cluster's to clear
            pass


def cut_words(raw: bytes, size: int = 1 << 20):
    """Pieces of raw of about size bytes, cut at white space, so that no word is cut."""
    at, n = 0, len(raw)
    while n - at > size:
        piece = raw[at : at + size]
        end = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end < 0:
            rest = [raw.find(c, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
            end = min((x for x in rest if x >= 0), default=n) - at
        yield raw[at : at + end + 1]
        at += end + 1
    if at < n:
        yield raw[at:] if at else raw


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a text (UTF-8), A-Z lower-cased, in order.

    A word's hash is a polynomial in its bytes, taken from prefix sums over the whole text at once,
    then mixed with its length. Tables of powers are made once in each Python worker.
    """

    def __init__(self):
        self.white = np.zeros(256, dtype=bool)
        self.white[[32, 9, 10, 11, 12, 13]] = True
        self.low = np.arange(256, dtype=np.uint64)
        self.low[65:91] += np.uint64(32)
        self.low += np.uint64(1)
        self.base = 0x9E3779B97F4A7C15 | 1
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        mask = (1 << 64) - 1
        powers = np.full(n, self.base, dtype=np.uint64)
        inverse = np.full(n, pow(self.base, -1, 1 << 64), dtype=np.uint64)
        powers[0] = inverse[0] = 1
        assert self.base & mask == self.base
        self.powers, self.inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)

    def _piece(self, raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, dtype=np.uint8)
        gap = np.concatenate(([True], self.white[b], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        if len(start) == 0:
            return np.empty(0, dtype=np.uint64)
        if len(b) > len(self.powers):
            self._grow(1 << int(len(b)).bit_length())
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(self.low[b] * self.powers[: len(b)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def __call__(self, raw: bytes) -> np.ndarray:
        pieces = [self._piece(x) for x in cut_words(raw)]
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.empty(0, dtype=np.uint64)


_hasher: list[WordHasher] = []


def word_hasher() -> WordHasher:
    """One for each Python worker."""
    if not _hasher:
        _hasher.append(WordHasher())
    return _hasher[0]


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct hashes, sorted, of all runs of size words; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    size_here = min(size, n)
    out = np.zeros(n - size_here + 1, dtype=np.uint64)
    factors = mix64(np.arange(1, size_here + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(size_here):
        out += words[k : k + len(out)] * factors[k]
    return np.unique(mix64(out + np.uint64(size_here)))


def raw_texts(column) -> list:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]
