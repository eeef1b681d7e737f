"""Column functions: built-in expressions where they can say it, Arrow batches of the kernels where not."""

from .builtin import *  # noqa: F403
from .kernels import *  # noqa: F403
