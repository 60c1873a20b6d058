"""Registries of strategies and kernels by name: chunkings and assemblies over tables, kernels as column functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Strategy:
    """``run(data, metadata)`` gives a table; ``outputs`` names its shape, which an assembly must take."""

    name: str
    kind: str
    run: Callable[..., DataFrame]
    outputs: str = "rows"
    streaming: bool = False
    schema: bool = True


@dataclass
class Registry:
    """Strategies are Python functions of this process; no code is taken over a wire."""

    items: dict[tuple[str, str], Strategy] = field(default_factory=dict)
    kernels: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def register(self, strategy: Strategy) -> None:
        if not callable(strategy.run) or strategy.kind not in ("chunking", "assembly"):
            raise ValueError(f"{strategy.name}: neither a chunking nor an assembly strategy")
        self.items[strategy.kind, strategy.name] = strategy

    def get(self, kind: str, name: str) -> Strategy:
        if (kind, name) not in self.items:
            raise KeyError(f"no {kind} strategy {name}; there are {sorted(n for k, n in self.items if k == kind)}")
        return self.items[kind, name]

    def kernel(self, name: str, function: Callable, kind: str) -> None:
        """A user's function of pandas series as a kernel that runs in Arrow batches; ``kind`` is its type."""
        self.kernels[name] = F.pandas_udf(function, kind)

    def apply(self, df: DataFrame, kernel: str, *inputs: str, output: str = "out") -> DataFrame:
        """``df`` with the named kernel's result."""
        if kernel not in self.kernels:
            raise KeyError(f"no kernel {kernel}; there are {sorted(self.kernels)}")
        return df.withColumn(output, self.kernels[kernel](*inputs))

    def compatible(self, chunking: str, assembly: str) -> tuple[bool, list[str]]:
        """Whether the two fit, and the assemblies that would."""
        made, wanted = self.get("chunking", chunking).outputs, self.get("assembly", assembly).outputs
        return made == wanted, sorted(s.name for (k, _), s in self.items.items() if k == "assembly" and s.outputs == made)

    def listing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.name, s.kind, s.outputs, s.streaming) for s in self.items.values()], "name string, kind string, outputs string, streaming boolean")

    def readiness(self, spark: SparkSession) -> DataFrame:
        """(name, kind, ready, missing): which strategies also run over streams, and what the others lack."""
        lacks = lambda s: ([] if s.streaming else ["a form over streams"]) + ([] if s.schema else ["a schema of its inputs"])
        return spark.createDataFrame([(s.name, s.kind, not lacks(s), lacks(s)) for s in self.items.values()], "name string, kind string, ready boolean, missing array<string>")

    def execute(self, chunking: str, assembly: str, data: DataFrame, metadata: dict | None = None) -> DataFrame:
        fits, others = self.compatible(chunking, assembly)
        if not fits:
            raise ValueError(f"{chunking} does not feed {assembly}; try {others}")
        return self.get("assembly", assembly).run(self.get("chunking", chunking).run(data, metadata or {}), metadata or {})


def built_in() -> Registry:
    """The strategies that come with the library."""
    from gridloom.functions import wide
    from gridloom.operators import linalg, sorting

    out = Registry()

    def linear(data: DataFrame, metadata: dict) -> DataFrame:
        size = int(metadata.get("chunk_size", 1000))
        return data.withColumn("chunk", F.floor(F.col(metadata.get("index", "idx")) / size))

    def tiles(rows: DataFrame, metadata: dict) -> DataFrame:
        return linalg.to_blocks(rows, int(metadata.get("tile_rows", linalg.TILE_ROWS)), int(metadata.get("block_cols", linalg.BLOCK_COLS)))

    def curves(data: DataFrame, metadata: dict) -> DataFrame:
        n = int(metadata["n"])
        powers = [r["q"] for r in wide.prime_powers(data.sparkSession, int(metadata["b1"])).orderBy("p").collect()]  # a parameter
        return wide.stage_one(data, n, powers, bool(metadata.get("compute_gcd", True)))

    chunkings = [("linear", linear, "chunks", True), ("block_matrix", tiles, "blocks", False), ("distributed_sort", linear, "chunks", True), ("curves", curves, "curves", True)]
    assemblies = [
        ("concatenate", lambda d, m: d.drop("chunk"), "chunks", True),
        ("sorted", lambda d, m: sorting.global_rank(d.drop("chunk"), F.asc(m.get("by", "v")), F.asc(m.get("index", "idx"))), "chunks", False),
        ("block_matrix", lambda d, m: linalg.matmul_blocked(d, d), "blocks", False),
        ("first_factor", lambda d, m: d.where("status = 2").orderBy("curve").limit(1), "curves", False),
        ("all_curves", lambda d, m: d, "curves", True),
    ]
    for kind, some in (("chunking", chunkings), ("assembly", assemblies)):
        for name, run, outputs, streaming in some:
            out.register(Strategy(name, kind, run, outputs, streaming))
    return out
