"""One model per Python worker, whatever the number of its tasks."""

import hashlib

from pyspark import cloudpickle

_loaded = {}


def model_key(make):
    """A name for what ``make`` builds: equal code and values give equal names."""
    return hashlib.sha256(cloudpickle.dumps(make)).hexdigest()


def loaded(key, make):
    """The model ``make`` builds; a worker keeps its last one for later tasks."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make()
    return _loaded[key]
