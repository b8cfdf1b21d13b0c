"""What a search asks for, and its validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

#: The accepted names.
SEARCH_TYPES = ("All", "Audios", "Images")
ALGORITHMS = ("DifferenceHash", "PerceptualHash", "BlockMeanHash")
#: The largest degree of similarity an algorithm takes.
MOST_DEGREE = {"DifferenceHash": 64, "PerceptualHash": 64, "BlockMeanHash": 256}


@dataclass(frozen=True)
class SearchParameters:
    folders: Sequence[str] = ()
    file_search_type: str | None = None
    degree_of_similarity: int | None = None
    perceptual_hash_algorithm: str | None = None
    include_sub_folders: bool = False
    min_size: int | None = None
    max_size: int | None = None
    included_file_types: Sequence[str] = field(default_factory=tuple)
    excluded_file_types: Sequence[str] = field(default_factory=tuple)


class InvalidSearch(ValueError):
    """Carries a dictionary of field names to messages."""

    def __init__(self, errors: dict[str, list[str]]):
        super().__init__("; ".join(m for found in errors.values() for m in found))
        self.errors = errors


def validate(p: SearchParameters) -> dict[str, list[str]]:
    """Messages by camel-case field; empty where the search is valid."""
    errors: dict[str, list[str]] = {}

    def add(name: str, message: str) -> None:
        errors.setdefault(name, []).append(message)

    if not p.folders:
        add("folders", "At least one folder is required")
    if p.file_search_type is None:
        add("fileSearchType", "The search type is required")
    elif p.file_search_type not in SEARCH_TYPES:
        add("fileSearchType", f"Unknown search type {p.file_search_type}")
    if p.file_search_type == "Images":
        if p.perceptual_hash_algorithm is None:
            add("perceptualHashAlgorithm", "An algorithm is required for images")
        elif p.perceptual_hash_algorithm not in ALGORITHMS:
            add("perceptualHashAlgorithm", f"Unknown algorithm {p.perceptual_hash_algorithm}")
        most = MOST_DEGREE.get(p.perceptual_hash_algorithm or "", 256)
        if p.degree_of_similarity is None:
            add("degreeOfSimilarity", "A degree of similarity is required for images")
        elif not 0 <= p.degree_of_similarity <= most:
            add("degreeOfSimilarity", f"The degree of similarity must be between 0 and {most}")
    if p.min_size is not None and p.max_size is not None and p.min_size > p.max_size:
        for name in ("minSize", "maxSize"):
            add(name, "The smallest size must not be larger than the largest")
    return errors


def checked(p: SearchParameters) -> SearchParameters:
    if errors := validate(p):
        raise InvalidSearch(errors)
    return p
