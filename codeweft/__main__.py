import sys

from codeweft.cli import main

sys.exit(main())
