"""Extension points: datasets, strategies, models and hooks by name, and rounds that put them together.

All of them are DataFrame transforms, so a round is one lazy plan however many
clients there are.  Names are registered from anywhere, also outside the package;
a name is taken once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import aggregate


class Registry:
    """Things of one kind by name."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str):
        def keep(thing):
            if name in self._known:
                raise ValueError(f"there is a {self.kind} {name} already")
            self._known[name] = thing
            return thing

        return keep

    def get(self, name: str):
        if name not in self._known:
            raise KeyError(f"no {self.kind} {name}; there are: {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


#: (spark, **options) -> samples with client_id.
DATASETS = Registry("dataset")
#: Classes of ``Strategy``.
STRATEGIES = Registry("strategy")
#: (samples, host) -> samples with prediction.
MODELS = Registry("model")
#: Classes of ``Hooks``.
HOOKS = Registry("hook")


class Hooks:
    """Six places of a round where parameters or samples may be changed (attacks, defences, logs); all leave things as they are."""

    def host_to_local(self, host: DataFrame, round_: int) -> DataFrame:
        return host

    def train_begin(self, samples: DataFrame, host: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
        return samples, host

    def upload_begin(self, params: DataFrame, round_: int) -> DataFrame:
        return params

    def aggregate_begin(self, params: DataFrame, round_: int) -> DataFrame:
        return params

    def client_exit(self) -> None:
        """After the last round, on the clients' side."""

    def host_exit(self) -> None:
        """After the last round, on the host's side."""


class Strategy:
    """What a round does: who takes part, what clients make of the host's parameters, what the host makes of theirs.

    Host parameters are (layer, pos, value), clients' have client_id too.
    """

    def selected(self, clients: DataFrame, round_: int) -> DataFrame:
        """(client_id) of those that take part: all."""
        return clients

    def local(self, samples: DataFrame, host: DataFrame, round_: int) -> DataFrame:
        raise NotImplementedError

    def sizes(self, samples: DataFrame) -> DataFrame:
        return samples.groupBy("client_id").agg(F.count("*").alias("n_train"))

    def merged(self, params: DataFrame, sizes: DataFrame, host: DataFrame, round_: int) -> DataFrame:
        return aggregate.weighted_mean(params, sizes)

    def finished(self, host: DataFrame, round_: int) -> bool:
        return False


@MODELS.register("linear")
def linear(samples: DataFrame, host: DataFrame) -> DataFrame:
    """x . w: the host's first layer as one row (as wide as a sample) beside all samples."""
    w = host.where("layer = 0").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda c: c["value"]).alias("_w"))
    dot = F.aggregate(F.zip_with("x", "_w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return samples.crossJoin(F.broadcast(w)).withColumn("prediction", dot).drop("_w")


@STRATEGIES.register("gradient_step")
class GradientStep(Strategy):
    """Each client's parameters after one step down the gradient of its mean squared error; samples have x and y."""

    def __init__(self, lr: float = 1.0, model: str = "linear"):
        self.lr, self.model = lr, MODELS.get(model)

    def local(self, samples: DataFrame, host: DataFrame, round_: int) -> DataFrame:
        told = self.model(samples, host).select("client_id", (F.col("prediction") - F.col("y")).alias("d"), F.posexplode("x").alias("pos", "v"))
        grad = told.groupBy("client_id", "pos").agg(F.avg(F.col("d") * F.col("v")).alias("g"))
        step = grad.join(host.where("layer = 0"), "pos")
        return step.select("client_id", "layer", "pos", (F.col("value") - self.lr * F.col("g")).alias("value"))


def run_round(samples: DataFrame, host: DataFrame, strategy: Strategy, hooks: Iterable[Hooks] = (), round_: int = 0) -> DataFrame:
    """The host's parameters after one round; each place's hooks are applied in the order given."""
    chosen = strategy.selected(samples.select("client_id").distinct(), round_)
    own, sent = samples.join(chosen, "client_id", "left_semi"), host
    for h in hooks:
        sent = h.host_to_local(sent, round_)
    for h in hooks:
        own, sent = h.train_begin(own, sent, round_)
    params = strategy.local(own, sent, round_)
    for h in hooks:
        params = h.upload_begin(params, round_)
    for h in hooks:
        params = h.aggregate_begin(params, round_)
    return strategy.merged(params, strategy.sizes(own), host, round_)


def run_rounds(samples: DataFrame, host: DataFrame, strategy: Strategy, rounds: int, hooks: Iterable[Hooks] = (), settle: Callable[[DataFrame], DataFrame] = lambda host: host) -> DataFrame:
    """Several rounds; ``settle`` may write the host's parameters out and read them again, which keeps plans short."""
    hooks = list(hooks)
    for k in range(rounds):
        host = settle(run_round(samples, host, strategy, hooks, k))
        if strategy.finished(host, k):
            break
    for h in hooks:
        h.client_exit()
    for h in hooks:
        h.host_exit()
    return host
