"""All registered queries: importing the modules fills the registry."""

from spotlake.plans import decoders, digests, evidence, exchanges, lookups, losses, messages, radio, reports, rules, scores, spectra, texts, timeline, tones, wires  # noqa: F401
from spotlake.plans.registry import ORACLES, QUERIES  # noqa: F401
