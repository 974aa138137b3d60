import pytest

from quernworks.config import overridden
from quernworks.image.masks import MaskConfig
from quernworks.sources.manifest import ManifestConfig


def test_settings_from_environment_and_arguments():
    base = ManifestConfig("m.jsonl", "/root")
    got = overridden(base, ["max_records=5", "manifest=123"], {"QUERNWORKS_ON_COLLISION": "keep_first", "QUERNWORKS_MAX_RECORDS": "9", "OTHER": "x"})
    assert got == ManifestConfig("123", "/root", "keep_first", 5) and base.max_records is None
    assert overridden(base, ["download_missing=true", "max_records=null"]).download_missing is True
    mask = overridden(MaskConfig(), ["global_area=1", "min_side=32"], {})
    assert (mask.global_area, mask.min_side) == (1.0, 32) and isinstance(mask.global_area, float)
    for odd in (["nothing=1"], ["max_records"], ["download_missing=7"]):
        with pytest.raises(ValueError):
            overridden(base, odd, {})
    with pytest.raises(TypeError):
        overridden({}, [], {})
