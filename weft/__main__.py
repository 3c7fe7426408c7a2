import sys

from weft.cli import main

sys.exit(main())
