"""A unigram model for the sentencepiece library, made of a merge model's file and other scores."""

import struct


def _varint(data, i):
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if not data[i - 1] & 128:
            return value, i


def _number(value):
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _fields(data):
    i = 0
    while i < len(data):
        tag, j = _varint(data, i)
        if tag & 7 == 0:
            _, end = _varint(data, j)
        elif tag & 7 == 2:
            n, j = _varint(data, j)
            end = j + n
        else:
            end = j + (4 if tag & 7 == 5 else 8)
        yield tag, data[j:end], data[i:end]
        i = end


def unigram_model(model, scores):
    """model: bytes of the file; scores by id. The trainer's model type becomes 1, unigram."""
    out, n = bytearray(), 0
    for tag, body, whole in _fields(model):
        if tag >> 3 == 1:
            body = b"".join(x for t, _, x in _fields(body) if t >> 3 != 2) + _number(2 << 3 | 5) + struct.pack("<f", scores[n])
            n += 1
        elif tag >> 3 == 2:
            body = b"".join(_number(3 << 3) + _number(1) if t >> 3 == 3 else x for t, _, x in _fields(body))
        else:
            out += whole
            continue
        out += _number(tag) + _number(len(body)) + body
    return bytes(out)
