"""Page-localization analytics on Spark.

Every operator is a plain function ``DataFrame(s) -> DataFrame``:

* ``inkloom.functions``  column expressions (boxes, text, ordering, languages)
* ``inkloom.operators``  batch transforms over pages, regions and responses
* ``inkloom.sources``    file layouts read and written through the stock readers
* ``inkloom.streaming``  Structured Streaming jobs over job and page events
* ``inkloom.plans``      adapter views over the test tables and the query catalog
"""

import sys

from pyspark import cloudpickle

# the few Python helpers travel with their tasks, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
