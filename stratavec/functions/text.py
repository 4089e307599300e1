"""Tokenizers: Columns of token arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default dictionary of the longest-match tokenizer.
DEFAULT_DICTIONARY = """
的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她
什么 那 被 从 它 吗 这个 那个 可以 我们 他们 她们 因为 所以 但是 如果 虽然
搜索 向量 数据库 索引 查询 文档 插入 删除 更新 创建 打开 关闭 结果 分数 距离 相似 算法 模型 训练 数据 分析 处理 计算 存储
中文 英文 分词 全文 匹配 排序 过滤 聚合
""".split()
DEFAULT_LONGEST = 4
#: Bytes of texts whose tokens are held at a time, unless one text is longer.
SLICE = 1 << 20


def standard(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def whitespace(text: Column) -> Column:
    """Runs of anything but white space, case kept."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def longest_match(words: list[str] | None = None) -> Callable[[Column], Column]:
    """Forward maximum match against a dictionary; a letter or digit outside it is a token of its own.

    The dictionary goes with the function; the scan of a text is sequential, so it is an Arrow function.
    """
    known = frozenset(words if words is not None else DEFAULT_DICTIONARY)
    longest = DEFAULT_LONGEST if words is None else max([1, *map(len, known)])

    def cut(text: str) -> list[str]:
        out, i = [], 0
        while i < len(text):
            size = next((n for n in range(min(longest, len(text) - i), 0, -1) if text[i : i + n] in known), 0)
            if size or text[i].isalpha() or text[i].isdecimal():
                out.append(text[i : i + (size or 1)].lower())
            i += size or 1
        return out

    def arrays(texts: pa.Array) -> pa.Array:
        """Token arrays of texts, by one text's tokens at a time as objects: a letter may be a token, and so an object is many times its size."""
        if not len(texts):
            return pa.array([], pa.list_(pa.string()))
        done, offsets = [], [0]
        for text in texts:
            out = cut(text.as_py() or "")
            done.append(pa.array(out, pa.string()))
            offsets.append(offsets[-1] + len(out))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(done), mask=texts.is_null())

    @F.arrow_udf("array<string>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
                yield arrays(texts.slice(at, stop - at))
                at = stop

    return tokens


def tokenizer(name: str = "standard", filters: tuple = (), words: list[str] | None = None) -> Callable[[Column], Column]:
    made = {"standard": standard, "whitespace": whitespace}.get(name) or (longest_match(words) if name == "jieba" else standard)
    return (lambda text: lowercase(made(text))) if "lowercase" in filters else made
