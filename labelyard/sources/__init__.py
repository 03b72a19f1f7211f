from .cache import cached_predictions, load_or_fit, text_hash  # noqa: F401
from .fixtures import (  # noqa: F401
    IngestSpec, available_fixtures, build_manifest, fixture_detail, ingest, ingest_train,
    read_fixture, read_manifest, read_train, write_fixture, write_manifest,
)
from .datasets import DATASETS, TRAIN_ROWS  # noqa: F401
