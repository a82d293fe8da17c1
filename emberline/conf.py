"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class BurstConf:
    """Parameters of the burst jobs; ``width`` is the slice length in seconds.

    ``search_terms`` is the number of bursting terms a streaming window searches for per topic (None: all);
    ``horizon`` the number of slots a delivered post is compared with new ones (None: for ever).
    """

    width: int = 60
    minor: int = 1
    major: int = 30
    per_window_max: int = 30
    burst_threshold: float = 0.01
    sim_threshold: float = 0.5
    query_threshold: float = 0.0
    max_hashtags: int = 3
    max_urls: int = 2
    min_tokens: int = 3
    match_threshold: float = 0.2
    min_token_length: int = 3
    min_post_count: int = 100
    min_hashtag_count: int = 20
    max_relevant_posts: int = 1000
    max_taken_tokens: int = 10
    max_taken_tags: int = 3
    use_bigrams: bool = False
    threshold_modifier: float = 0.75
    repost_threshold: int = 100
    terms_per_window: int = 10
    burst_term_length: int = 4
    lang: str = "en"
    spam_terms: tuple[str, ...] = ("follow",)
    search_terms: int | None = 100
    horizon: int | None = None

    def with_(self, **changes) -> "BurstConf":
        return replace(self, **changes)


# Property-file keys and the field each one sets.
PROPERTY_FIELDS = {
    "MINOR_WINDOW_SIZE": "minor",
    "MAJOR_WINDOW_SIZE": "major",
    "PER_MINUTE_MAX": "per_window_max",
    "BURST_THRESHOLD": "burst_threshold",
    "SIM_THRESHOLD": "sim_threshold",
    "QUERY_THRESHOLD": "query_threshold",
    "MAX_HASHTAGS": "max_hashtags",
    "MIN_TOKENS": "min_tokens",
    "MAX_URLS": "max_urls",
    "MATCH_THRESHOLD": "match_threshold",
    "MIN_TOKEN_LENGTH": "min_token_length",
    "MIN_TWEET_COUNT": "min_post_count",
    "MIN_HASHTAG_COUNT": "min_hashtag_count",
    "MAX_RELEVANT_TWEETS": "max_relevant_posts",
    "MAX_TAKEN_TOKENS": "max_taken_tokens",
    "MAX_TAKEN_TAGS": "max_taken_tags",
    "USE_BIGRAMS": "use_bigrams",
    "RETWEET_THRESHOLD": "repost_threshold",
}


def load_properties(path: str) -> BurstConf:
    """Read a ``KEY = value`` property file; unknown keys are ignored."""
    kinds = {f.name: type(f.default) for f in fields(BurstConf)}
    changes = {}
    with open(path, encoding="utf-8") as handle:
        for line in handle:
            line = line.strip()
            if not line or line[0] in "#!" or "=" not in line:
                continue
            key, value = (part.strip() for part in line.split("=", 1))
            name = PROPERTY_FIELDS.get(key)
            if name is None:
                continue
            kind = kinds[name]
            changes[name] = value.lower() == "true" if kind is bool else kind(value)
    return BurstConf(**changes)
