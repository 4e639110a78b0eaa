"""A study: the daily frame of its participants with domains, which changes by steps that can be taken back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cohort

#: Columns of a daily frame that are no domains.
KEYS = ("participant_id", "day", "bin", "Date", "id")


def domain_check(daily: DataFrame, domains: Sequence[str] | None = None) -> DataFrame:
    """domain, state, n_values, n_participants and n_without (participants without any value) of each domain asked for, all that daily has
    by default.

    state is unknown where daily has no such column, empty where all its values are null or NaN, text where they are no numbers, else ok. A domain
    that is asked for twice has one row.
    """
    asked = list(dict.fromkeys(cohort._each(daily, None) if domains is None else domains))
    kinds = dict(daily.dtypes)
    number = {c: kinds.get(c, "").startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) for c in asked}

    def value(c: str):
        if c not in kinds:
            return F.lit(None).cast("boolean")
        known = F.col(c).isNotNull()
        return F.when(known & ~F.isnan(c) if kinds[c] in ("double", "float") else known, True)

    person = daily.groupBy("participant_id").agg(*(F.count(value(c)).alias(f"n{i}") for i, c in enumerate(asked)))
    sums = [F.struct(F.lit(c).alias("domain"), F.lit("unknown" if c not in kinds else "ok" if number[c] else "text").alias("state"), F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("n_values"), F.count(F.when(F.col(f"n{i}") == 0, 1)).alias("n_without")) for i, c in enumerate(asked)]
    rows = person.agg(F.array(*sums).alias("all"), F.count("*").alias("n_participants")).select("n_participants", F.explode("all").alias("d"))
    state = F.when((F.col("d.state") != "unknown") & (F.col("d.n_values") == 0), "empty").otherwise(F.col("d.state"))
    return rows.select("d.domain", state.alias("state"), "d.n_values", "n_participants", "d.n_without")


@dataclass(frozen=True)
class Study:
    """Participants' daily frame (participant_id, day, domains) with its versions: the first is as it was given, each step adds one.

    A study does not change; a step gives a new one. properties: participant_id and what is known of the person, such as age.
    """

    daily: DataFrame
    domains: tuple[str, ...] | None = None
    properties: DataFrame | None = None
    versions: tuple[tuple[str, DataFrame], ...] = field(default=())

    @property
    def steps(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.versions)

    def checked(self, domains: Sequence[str] | None = None) -> list[str]:
        """The domains asked for, else those of the study, else all of its frame; unknown ones raise."""
        names = list(domains if domains is not None else self.domains if self.domains is not None else cohort._each(self.daily, None))
        if lacking := [c for c in names if c not in self.daily.columns]:
            raise ValueError(f"unknown domains: {', '.join(lacking)}")
        return names

    def check(self, domains: Sequence[str] | None = None) -> DataFrame:
        return domain_check(self.daily, self.domains if domains is None else domains)

    def _step(self, name: str, function: Callable[..., DataFrame], domains: Sequence[str] | None, **options) -> Study:
        return replace(self, daily=function(self.daily, self.checked(domains), **options), versions=(*self.versions, (name, self.daily)))

    def imputed(self, domains: Sequence[str] | None = None, **options) -> Study:
        return self._step("impute", cohort.imputed, domains, **options)

    def normalized(self, domains: Sequence[str] | None = None, whole: bool = False) -> Study:
        """By each participant's own mean and deviation, or by those of the whole study."""
        return self._step("normalize", cohort.cohort_normalized if whole else cohort.normalized, domains)

    def binned(self, domains: Sequence[str] | None = None, days: int = 3) -> Study:
        return self._step("bin", cohort.binned, domains, days=days)

    def reset(self, to: int = 0) -> Study:
        """The study as it was before its step number to (from 0): by default as it was given."""
        if not self.versions:
            return self
        return replace(self, daily=self.versions[to][1], versions=self.versions[:to] if to >= 0 else self.versions[: len(self.versions) + to])

    def participant(self, participant_id: object) -> DataFrame:
        """The frame of one participant; no rows if the study has none of that id."""
        return self.daily.where(F.col("participant_id") == participant_id)

    def ids(self) -> DataFrame:
        return self.daily.select("participant_id").distinct()

    def __len__(self) -> int:
        return self.ids().count()

    def __iter__(self) -> Iterator[object]:
        """Ids of the participants in order, as they are read."""
        return (r[0] for r in self.ids().orderBy("participant_id").toLocalIterator())

    def with_participants(self, daily: DataFrame) -> Study:
        """More participants, in every version: rows of those that are known already replace theirs. Steps that were taken are not
        taken for them, so take them after adding, or reset first."""
        if self.versions:
            raise ValueError("reset the study before adding participants")
        old = self.daily.join(daily.select("participant_id").distinct(), "participant_id", "left_anti")
        return replace(self, daily=old.unionByName(daily, allowMissingColumns=True))

    def age_statistics(self) -> DataFrame:
        if self.properties is None:
            raise ValueError("the study has no properties")
        return cohort.age_statistics(self.properties.join(self.ids(), "participant_id", "left_semi"))
