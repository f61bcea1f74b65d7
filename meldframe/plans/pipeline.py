"""Declarative transforms: functions with named inputs and outputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import wraps
from typing import Any

from meldframe.sources.io import Input, Output


def _require(kind: type, **named: Any) -> None:
    for name, value in named.items():
        if not isinstance(value, kind):
            raise TypeError(f"{name} must be an {kind.__name__}, not {type(value).__name__}")


def transform_df(*, output: Output, **inputs: Input) -> Callable:
    """The decorated function gets a DataFrame for each input; what it returns is written to ``output`` and returned.

    ``compute`` runs it, as does a call. Returning None is an error. The returned DataFrame is lazy:
    using it again computes it again, so read the output instead where that matters.
    """
    _require(Output, output=output), _require(Input, **inputs)

    def decorate(fn: Callable) -> Callable:
        @wraps(fn)
        def compute() -> Any:
            result = fn(**{name: source.dataframe() for name, source in inputs.items()})
            if result is None:
                raise ValueError(f"{fn.__name__} returned None; it must return what to write")
            output.write(result)
            return result

        compute.compute, compute.inputs, compute.output = compute, inputs, output
        return compute

    return decorate


def transform(*, output: Output | None = None, outputs: Mapping[str, Output] | None = None, **inputs: Input) -> Callable:
    """The decorated function gets the inputs and outputs themselves, and writes on its own."""
    if (output is None) == (outputs is None):
        raise TypeError("give either output or outputs")
    named = {"output": output} if outputs is None else dict(outputs)
    _require(Output, **named), _require(Input, **inputs)
    if both := sorted(set(named) & set(inputs)):
        raise TypeError(f"both an input and an output: {', '.join(both)}")

    def decorate(fn: Callable) -> Callable:
        @wraps(fn)
        def compute() -> Any:
            return fn(**inputs, **named)

        compute.compute, compute.inputs, compute.outputs = compute, inputs, named
        return compute

    return decorate
