"""Plug-in surface: kernels registered by test id, and embedding models run once a partition."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

REGISTRY: dict[str, Callable] = {}


def register(engine_id: str, kernel: Callable) -> None:
    """A pairwise kernel (a, b) -> float or None under a catalogue id or a new one."""
    REGISTRY[engine_id] = kernel


def embed(images: DataFrame, module: str, id_col: str = "img_id", data_col: str = "content") -> DataFrame:
    """Vectors from a module that defines NAME, setup() and embed(state, data); setup runs once a task.

    The module is imported by name on the executors; an item that fails has a null vector and a message.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = importlib.import_module(module)
        state = m.setup()
        for pdf in frames:
            rows = []
            for key, data in zip(pdf[id_col], pdf[data_col], strict=True):
                try:
                    rows.append((key, m.NAME, [float(x) for x in m.embed(state, data)], None))
                except (ValueError, ArithmeticError, RuntimeError) as e:
                    rows.append((key, m.NAME, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[id_col, "model", "vec", "error"])

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, data_col).mapInPandas(run, f"`{id_col}` {kind}, model string, vec array<double>, error string")


def onnx(path: str) -> tuple[Callable, Callable]:
    """setup and embed of an ONNX file with one input and one output (threads: one a worker)."""

    def setup():
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        return ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])

    def run(session, tensor):
        return session.run(None, {session.get_inputs()[0].name: tensor})[0].ravel()

    return setup, run
