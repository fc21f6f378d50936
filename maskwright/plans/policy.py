"""What to look for and how to rewrite it.  Compiled into expressions on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from ..functions.masking import STYLES

# Categories.
CATEGORIES = (
    "email", "phone", "ipv4", "ipv6", "mac", "url_credential", "tfn", "abn", "acn", "medicare", "medicare_enrolment", "passport", "drivers_licence", "credit_card", "bsb", "postcode", "street_address", "state_postcode",
    "iban", "date", "date_au", "date_iso", "name", "organisation", "location", "age", "gender", "organisation_name", "internal_term", "award", "job_title", "tenure", "team_size", "employment_status", "health_detail", "implication",
)
DIRECT = ("email", "phone", "tfn", "medicare", "medicare_enrolment", "passport", "drivers_licence", "credit_card", "iban", "street_address", "name", "ipv4", "ipv6", "bsb")
QUASI = ("job_title", "tenure", "team_size", "employment_status", "health_detail", "implication", "age", "gender", "date_au", "date_iso", "location")


@dataclass(frozen=True)
class Policy:
    """``categories``: None for all.  ``generalise``: widened to bands instead of masked.
    ``styles``: category (or "default") -> style.  ``survey``: organisation, lexicon, award,
    quasi-identifier and implication detectors too.  ``salt``: for hash and token; without
    one, tokens get a salt made once on the driver.  ``require_checksum``: True drops numbers
    whose check digits fail, False keeps them all at confidence 0.4; None leaves it to each
    detector."""

    categories: frozenset[str] | None = None
    generalise: frozenset[str] = frozenset()
    styles: dict[str, str] = field(default_factory=dict)
    default_style: str = "mask"
    nlp: bool = False
    nlp_min_confidence: float = 0.55
    min_confidence: float = 0.0
    salt: bytes | None = None
    mask_char: str = "*"
    keep_prefix: int = 0
    keep_suffix: int = 4
    strict: bool = False
    require_checksum: bool | None = None
    survey: bool = False
    implicates: frozenset[str] = frozenset(("person", "workplace"))

    def __post_init__(self):
        unknown = ({*(self.categories or ()), *self.generalise, *self.styles} - {"default"}) - set(CATEGORIES)
        if unknown:
            raise ValueError(f"unknown categories: {', '.join(sorted(unknown))}")
        bad = {*self.styles.values(), self.default_style} - set(STYLES)
        if bad:
            raise ValueError(f"unknown styles: {', '.join(sorted(bad))}")
        if isinstance(self.salt, str):
            object.__setattr__(self, "salt", bytes.fromhex(self.salt))

    def style_of(self, category: str) -> str:
        return self.styles.get(category, self.styles.get("default", self.default_style))

    def enabled(self, category: str) -> bool:
        return self.categories is None or category in self.categories

    def with_changes(self, **changes) -> Policy:
        return replace(self, **changes)

    def to_json(self) -> str:
        d = asdict(self) | {"categories": sorted(self.categories) if self.categories is not None else None, "generalise": sorted(self.generalise), "implicates": sorted(self.implicates), "salt": self.salt.hex() if self.salt else None}
        return json.dumps(d, sort_keys=True)

    def cache_key(self) -> str:
        """Equal for equal policies, and only for them."""
        return self.to_json()

    @staticmethod
    def from_json(text: str) -> Policy:
        d = json.loads(text)
        sets = {k: frozenset(d[k]) if d[k] is not None else None for k in ("categories", "generalise", "implicates")}
        return Policy(**d | sets | {"salt": bytes.fromhex(d["salt"]) if d["salt"] else None})


LABELLED = ("health_detail", "organisation_name", "internal_term", "award", "implication", "job_title", "employment_status")


def survey_policy(**changes) -> Policy:
    """The survey profile: attribution and implication labelled, measures banded."""
    base = Policy(survey=True, styles={c: "label" for c in LABELLED}, generalise=frozenset(("age", "tenure", "team_size", "date_au", "date_iso")), nlp=True)
    return replace(base, **changes)
