"""``python -m strideframe``."""

from strideframe.cli import main

main()
