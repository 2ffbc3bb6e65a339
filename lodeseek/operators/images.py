"""Pixels and models: image profiles, OCR and page encoders, in Arrow batches. [K8, K9, O]

Engines are passed in: a page engine is a callable from an image (a height x width x 3 array) to text. A task makes
its engine once, through the factory it is given, so a model is loaded once for each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.session import ship

MODES = ("Pure Local", "Pure Cloud", "Hybrid")


class EncoderUnavailableError(RuntimeError):
    """The page encoder's packages are not installed."""


def decode(row) -> np.ndarray | None:
    """Spark's image struct (BGR or grey bytes) as RGB."""
    if row is None or row["data"] is None or row["nChannels"] not in (1, 3, 4):
        return None
    x = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, 2::-1]


def luminance(image: np.ndarray) -> np.ndarray:
    """Rounded ITU-R 601 grey values."""
    r, g, b = (image[:, :, i].astype(np.int64) for i in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16


def edge_mean(grey: np.ndarray) -> float:
    """Mean of a 3 x 3 edge filter (8 in the middle, -1 around); border values stay as they are."""
    out = grey.copy()
    if min(grey.shape) > 2:
        near = sum(grey[1 + dy : grey.shape[0] - 1 + dy, 1 + dx : grey.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[1:-1, 1:-1] = np.clip(9 * grey[1:-1, 1:-1] - near, 0, 255)
    return float(out.mean())


def level(name: str, value: float, high: float, low: float) -> list[str]:
    """name_high above the one bound, name_low below the other, nothing between them."""
    return [f"{name}_high"] if value > high else [f"{name}_low"] if value < low else []


def image_profile(image: np.ndarray | None) -> str:
    """Words for the layout of an image; ``layout_unknown`` without one. [K8]"""
    if image is None or not image.size:
        return "layout_unknown"
    grey = luminance(image)
    share = np.bincount(grey.ravel(), minlength=256) / grey.size
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    ratio = image.shape[1] / max(image.shape[0], 1)
    form = "landscape" if ratio > 1.35 else "portrait" if ratio < 0.8 else "square"
    words = ["layout_visual", f"orientation_{form}", *level("texture", entropy, 5.4, 4.0), *level("contrast", float(grey.std()), 62, 36)]
    return " ".join([*words, *level("line_density", edge_mean(grey), 28, 15), *level("brightness", float(grey.mean()), 180, 95)])


def image_profiles(images: DataFrame, key: str = "page_id") -> DataFrame:
    """key, profile; images has key and image (Spark's image struct)."""
    ship(images.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([image_profile(decode(x)) for x in b.column(1).to_pylist()])], names=[key, "profile"])

    return images.select(F.col(key).cast("string").alias(key), "image").mapInArrow(run, f"{key} string, profile string")


def target_size(width: int, height: int, most: int = 2400, least: int = 1200) -> tuple[int, int]:
    """The long side at most ``most``, unless that takes the short side below ``least``. [O3]"""
    if max(width, height) <= most:
        return width, height
    by = lambda scale: (int(width * scale), int(height * scale))
    small = by(most / max(width, height))
    return small if min(small) >= least else by(least / min(width, height))


def resize(image: np.ndarray, most: int = 2400, least: int = 1200) -> np.ndarray:
    width, height = target_size(image.shape[1], image.shape[0], most, least)
    rows, columns = (np.arange(n) * m // n for n, m in ((height, image.shape[0]), (width, image.shape[1])))
    return image[rows][:, columns]


def crop(image: np.ndarray) -> np.ndarray:
    """The document's rectangle, straightened, where OpenCV is installed and finds four corners; else the image. [O2]"""
    try:
        import cv2
    except ImportError:
        return image
    grey = cv2.GaussianBlur(cv2.cvtColor(image, cv2.COLOR_RGB2GRAY), (5, 5), 0)
    cut, _ = cv2.threshold(grey, 0, 255, cv2.THRESH_BINARY + cv2.THRESH_OTSU)
    shapes, _ = cv2.findContours(cv2.dilate(cv2.Canny(grey, 0.5 * cut, cut), np.ones((5, 5))), cv2.RETR_LIST, cv2.CHAIN_APPROX_SIMPLE)
    area = image.shape[0] * image.shape[1]
    for shape in sorted(shapes, key=cv2.contourArea, reverse=True)[:10]:
        corners = cv2.approxPolyDP(shape, 0.02 * cv2.arcLength(shape, True), True)
        if len(corners) == 4 and 0.15 * area <= cv2.contourArea(corners) <= 0.98 * area:
            p = corners.reshape(4, 2).astype(np.float32)
            total, gap = p.sum(axis=1), np.diff(p, axis=1).ravel()
            p = np.array([p[total.argmin()], p[gap.argmin()], p[total.argmax()], p[gap.argmax()]])
            w, h = (int(max(np.linalg.norm(p[a] - p[b]), np.linalg.norm(p[c] - p[d]))) for a, b, c, d in ((0, 1, 3, 2), (0, 3, 1, 2)))
            to = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], np.float32)
            return cv2.warpPerspective(image, cv2.getPerspectiveTransform(p, to), (w, h))
    return image


def attempt(call: Callable, retries: int = 2):
    """call(), tried again after errors; None when all tries failed. [O5]"""
    for _ in range(retries + 1):
        try:
            return call()
        except Exception:  # noqa: BLE001 an engine may fail in any way
            continue
    return None


def read_page(image: np.ndarray, mode: str, local: Callable | None, cloud: Callable | None) -> tuple[str, str]:
    """(local text, final text) of a page; ("", "") when it fails. [O0, O1]"""
    try:
        page = resize(crop(image))
        first = (local(page) or "") if local and mode != "Pure Cloud" else ""
        if mode == "Pure Local" or cloud is None:
            return first, first
        better = attempt(lambda: cloud(page, first if mode == "Hybrid" else ""))
        return first, first if better is None else better
    except Exception:  # noqa: BLE001
        return "", ""


def ocr(images: DataFrame, engines: Callable[[], tuple[Callable | None, Callable | None]], mode: str = "Hybrid", key: str = "page_id") -> DataFrame:
    """key, glm_text, text. engines() gives a worker its (local, cloud) engines; an engine may be None."""
    if mode not in MODES:
        raise ValueError(f"Unsupported OCR mode: {mode}")
    ship(images.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        local, cloud = engines()
        for b in batches:
            pages = [(x is not None and read_page(x, mode, local, cloud)) or ("", "") for x in map(decode, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p[0] for p in pages], pa.string()), pa.array([p[1] for p in pages], pa.string())], names=[key, "glm_text", "text"])

    return images.select(F.col(key).cast("string").alias(key), "image").mapInArrow(run, f"{key} string, glm_text string, text string")


def encode_pages(images: DataFrame, encoder: Callable[[], Callable] | None, key: str = "page_id") -> DataFrame:
    """item_id, vectors (array of arrays). encoder() gives a worker its callable from an image to a list of vectors."""
    if encoder is None:
        raise EncoderUnavailableError("No page encoder: install the packages of a multi-vector page model and pass its factory.")
    if images.limit(1).count() == 0:
        raise ValueError("No page images to index")
    ship(images.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder()
        for b in batches:
            out = [[[float(v) for v in row] for row in encode(x)] if (x := decode(r)) is not None else [] for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["item_id", "vectors"])

    return images.select(F.col(key).cast("string").alias("item_id"), "image").mapInArrow(run, "item_id string, vectors array<array<double>>")
