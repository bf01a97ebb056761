"""The queries: importing this package registers them all in ``registry``."""

from veridex.plans import records as records
from veridex.plans import registry as registry
