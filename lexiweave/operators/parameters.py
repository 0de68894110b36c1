"""Trainers' option strings: -c 1 -t 2 … as the two SVM libraries' command lines have them."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field

#: Formulations and kernels by number, and those that are trained here.
KERNELS = {0: "linear", 1: "polynomial", 2: "rbf", 3: "sigmoid"}
LINEAR = {0: "logreg", 1: "svc", 2: "svc", 3: "svc", 6: "l1-logreg", 7: "logreg"}


@dataclass(frozen=True)
class Parameters:
    """kind: rbf, svc, logreg or l1-logreg. gamma 0 stands for 1 / the largest attribute id; bias below 0 for none."""

    kind: str = "rbf"
    cost: float = 1.0
    gamma: float = 0.0
    probability: bool = False
    folds: int = 0
    bias: float = -1.0
    eps: float = 1e-3
    weights: dict[int, float] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str | None, library: str = "kernel") -> Parameters:
        """Of the kernel library (default: C-SVC with an RBF kernel) or the linear one (default: a linear SVC).

        All numbers may have fractions. Options that only steer a trainer's inner work (degree, coefficient, nu, cache,
        shrinking, epsilon of regressions, quiet) are read and have no effect; unknown options, a missing value, and
        formulations that are not trained here are errors.
        """
        if library not in ("kernel", "linear"):
            raise ValueError(f"unknown library: {library!r}")
        words, given, weights = shlex.split(text or ""), {}, {}
        at = 0
        while at < len(words):
            name = words[at]
            if name == "-q":
                at += 1
                continue
            if len(name) < 2 or name[0] != "-" or at + 1 >= len(words):
                raise ValueError(f"not an option with a value: {name!r}")
            try:
                value = float(words[at + 1])
                if name[1] == "w":
                    weights[int(name[2:])] = value
                elif name[1:] in ("s", "t", "d", "g", "r", "n", "m", "c", "e", "p", "v", "h", "b", "B"):
                    given[name[1:]] = value
                else:
                    raise ValueError
            except ValueError:
                raise ValueError(f"bad option: {name} {words[at + 1]}") from None
            at += 2
        kind = cls._kind(given, library)
        out = cls(kind, given.get("c", 1.0), given.get("g", 0.0), bool(given.get("b", 0)) or kind.endswith("logreg"), int(given.get("v", 0)), given.get("B", -1.0), given.get("e", 1e-3), weights)
        if out.cost <= 0 or out.gamma < 0 or out.eps <= 0:
            raise ValueError("cost and tolerance must be positive, gamma not negative")
        if "v" in given and out.folds < 2:
            raise ValueError("at least two folds are needed")
        return out

    @staticmethod
    def _kind(given: dict[str, float], library: str) -> str:
        if library == "linear":
            solver = int(given.get("s", 1))
            if solver not in LINEAR:
                raise ValueError(f"solver {solver} is not trained here; there are {sorted(LINEAR)}")
            return LINEAR[solver]
        if int(given.get("s", 0)) != 0:
            raise ValueError("of the kernel library only C-SVC (-s 0) is trained here")
        kernel = KERNELS.get(int(given.get("t", 2)))
        if kernel not in ("linear", "rbf"):
            raise ValueError(f"kernel {kernel or given['t']} is not trained here; there are linear (0) and rbf (2)")
        return "svc" if kernel == "linear" else "rbf"
