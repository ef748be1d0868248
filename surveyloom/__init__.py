"""Design-based survey statistics as Spark DataFrame jobs.

Functions that run in tasks are sent along with the job, so executors need not have the
package installed.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
