"""MD5 and SHA-1 of many short messages at once, in NumPy: one array operation is one step of all messages."""

from __future__ import annotations

import numpy as np

_MD5_K = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_MD5_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_MD5_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_SHA1_K = np.array([0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6], np.uint32)
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0]
LANES = 16384  # messages at a time: their state stays in the processor's cache


def _padded(text: np.ndarray, order: str) -> np.ndarray:
    """Messages of one length as whole blocks."""
    n, size = text.shape
    whole = np.zeros((n, 64 * ((size + 9 + 63) // 64)), np.uint8)
    whole[:, :size] = text
    whole[:, size] = 0x80
    whole[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little" if order == "<" else "big"), np.uint8)
    return whole


def _words(whole: np.ndarray, order: str) -> np.ndarray:
    """(blocks, 16, messages)"""
    return np.ascontiguousarray(whole.view(f"{order}u4").astype(np.uint32).reshape(len(whole), -1, 16).transpose(1, 2, 0))


def _turn(x: np.ndarray, by: int, spare: np.ndarray) -> None:
    np.right_shift(x, np.uint32(32 - by), out=spare)
    np.left_shift(x, np.uint32(by), out=x)
    np.bitwise_or(x, spare, out=x)


def _md5_block(state: list[np.ndarray], w: np.ndarray) -> list[np.ndarray]:
    a, b, c, d = (x.copy() for x in state)
    f, spare = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, w[_MD5_WORD[i]], out=a)
        np.add(a, _MD5_K[i], out=a)
        _turn(a, _MD5_TURN[i], spare)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [np.add(x, y) for x, y in zip(state, (a, b, c, d), strict=True)]


def _sha1_block(state: list[np.ndarray], w: np.ndarray) -> list[np.ndarray]:
    a, b, c, d, e = (x.copy() for x in state)
    f, spare, w = np.empty_like(a), np.empty_like(a), list(w.copy())
    for i in range(80):
        if i >= 16:
            np.bitwise_xor(w[(i - 3) % 16], w[(i - 8) % 16], out=f)
            np.bitwise_xor(f, w[(i - 14) % 16], out=f)
            np.bitwise_xor(w[i % 16], f, out=w[i % 16])
            _turn(w[i % 16], 1, spare)
        if i < 20:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif 40 <= i < 60:
            np.bitwise_or(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_and(c, d, out=spare)
            np.bitwise_or(f, spare, out=f)
        else:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        np.add(e, f, out=e)
        np.add(e, w[i % 16], out=e)
        np.add(e, _SHA1_K[i // 20], out=e)
        np.left_shift(a, np.uint32(5), out=f)
        np.right_shift(a, np.uint32(27), out=spare)
        np.bitwise_or(f, spare, out=f)
        np.add(e, f, out=e)
        _turn(b, 30, spare)
        a, b, c, d, e = e, a, b, c, d
    return [np.add(x, y) for x, y in zip(state, (a, b, c, d, e), strict=True)]


def _digest(texts: list[np.ndarray], block, parts: int, order: str) -> np.ndarray:
    whole = [_padded(t, order) for t in texts]
    at = np.cumsum([0, *[len(w) for w in whole]])
    out = np.empty((parts, at[-1]), np.uint32)
    for width in {w.shape[1] for w in whole}:  # messages of as many blocks go together
        some = [i for i, w in enumerate(whole) if w.shape[1] == width]
        rows, place = np.concatenate([whole[i] for i in some]), np.concatenate([np.arange(at[i], at[i + 1]) for i in some])
        for lo in range(0, len(rows), LANES):
            words = _words(rows[lo:lo + LANES], order)
            state = [np.full(words.shape[2], s, np.uint32) for s in _START[:parts]]
            for w in words:
                state = block(state, w)
            out[:, place[lo:lo + LANES]] = state
    return out


def md5_words(*texts: np.ndarray) -> np.ndarray:
    """(4, n): the words of the digests of the rows of byte matrices, one after the other, as they stand in the hex text (big-endian)."""
    return _digest(list(texts), _md5_block, 4, "<").byteswap()


def sha1_words(*texts: np.ndarray) -> np.ndarray:
    """(5, n): as ``md5_words``."""
    return _digest(list(texts), _sha1_block, 5, ">")
