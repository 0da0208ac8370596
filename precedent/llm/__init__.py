"""Operations of a training-data pipeline. Nothing else in the library imports
this package; ``__spark_entry__`` adds its queries when it can be imported.

Worker-side code is pickled by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
