"""DuckDB SQL text for XXH64 of a string, from its published steps, in unsigned 128-bit numbers modulo 2^64."""

from __future__ import annotations

#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_M = f"{2**64}::UHUGEINT"


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _mul(a: str, b: int) -> str:
    return f"({a} * {b}::UHUGEINT % {_M})"


def _turn(x: str, by: int) -> str:
    """A name (not an expression) rotated to the left."""
    return f"({x} * {2**by}::UHUGEINT % {_M} + {x} // {2 ** (64 - by)}::UHUGEINT)"


def _round(acc: str, lane: str) -> str:
    return _let("r", f"({acc} + {_mul(lane, _P2)}) % {_M}", _mul(_turn("r", 31), _P1))


def _number(first: str, size: int) -> str:
    """``size`` bytes of the list of hexadecimal bytes b from place ``first`` (counted from 0), little-endian."""
    return "('0x' || " + " || ".join(f"b[{first} + {k}]" for k in range(size, 0, -1)) + ")::UHUGEINT"


def xxh64(pairs: str, seed: int = 42) -> str:
    """Of a list of hexadecimal bytes; a UHUGEINT below 2^64."""
    starts = [(seed + _P1 + _P2) % 2**64, (seed + _P2) % 2**64, seed, (seed - _P1) % 2**64]
    lanes = [
        f"list_reduce(list_transform(range(0, len(b) // 32), lambda i: {_number(f'32 * i + {8 * k}', 8)}), lambda v, x: {_round('v', 'x')}, {start}::UHUGEINT)"
        for k, start in enumerate(starts)
    ]
    merged = f"({_turn('v[1]', 1)} + {_turn('v[2]', 7)} + {_turn('v[3]', 12)} + {_turn('v[4]', 18)}) % {_M}"
    for k in range(1, 5):
        merged = f"(xor({merged}, {_round('0::UHUGEINT', f'v[{k}]')}) * {_P1}::UHUGEINT + {_P4}::UHUGEINT) % {_M}"
    long = _let("v", f"[{', '.join(lanes)}]", merged)
    begun = f"((CASE WHEN len(b) >= 32 THEN {long} ELSE {(seed + _P5) % 2**64}::UHUGEINT END + len(b)::UHUGEINT) % {_M})"
    rest = "(len(b) // 32 * 32)"
    eights = f"list_transform(range(0, len(b) % 32 // 8), lambda i: {_number(f'{rest} + 8 * i', 8)})"
    after8 = f"list_reduce({eights}, lambda h, x: {_let('y', f'xor(h, {_round('0::UHUGEINT', 'x')})', f'({_mul(_turn("y", 27), _P1)} + {_P4}::UHUGEINT) % {_M}')}, {begun})"
    four = "(len(b) // 8 * 8)"
    after4 = _let("h", after8, f"CASE WHEN len(b) % 8 >= 4 THEN {_let('y', f'xor(h, {_mul(_number(four, 4), _P1)})', f'({_mul(_turn("y", 23), _P2)} + {_P3}::UHUGEINT) % {_M}')} ELSE h END")
    ones = "list_transform(range(0, len(b) % 4), lambda i: ('0x' || b[len(b) // 4 * 4 + i + 1])::UHUGEINT)"
    after1 = f"list_reduce({ones}, lambda h, x: {_let('y', f'xor(h, {_mul("x", _P5)})', _mul(_turn('y', 11), _P1))}, {after4})"
    last = after1
    for shift, prime in ((33, _P2), (29, _P3)):
        last = _let("h", last, _mul(f"xor(h, h // {2**shift}::UHUGEINT)", prime))
    last = _let("h", last, f"xor(h, h // {2**32}::UHUGEINT)")
    return _let("b", pairs, last)
